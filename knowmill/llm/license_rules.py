"""Hand-written license signatures: patterns over a text's normalised words, which single spaces part.

Normalised means: A-Z in lower case, and every other ASCII character than letters and digits turned to a gap, so that
"Apache-2.0" reads "apache 2 0". A pattern covers whole words. Kinds, from the strongest: ``spdx`` identifiers, ``text``
of a license or notice, ``grant`` that puts something under it, and its bare ``name``. ``keys``: substrings of which
each of the label's patterns holds one. Phrases of ``OTHER`` look like a license and are none; they suppress what lies
inside them.
"""

SIGNATURES = {
    "mit": {
        "keys": (
            "mit licen", "mit x11", "mit style licen", "mit open source licen", "license mit", "licenses mit", "licensed mit", "licensed as mit", "identifier mit", "licensed under mit",
            "licensed under the mit", "expat", "permission is hereby granted free", "permission notice shall be included", "x11", "massachusetts institute of technology licen",
        ),
        "spdx": ["spdx license identifier mit", "spdx license identifier x11", "license mit", "licenses mit"],
        "text": [
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "permission is hereby granted free of charge to any person obtaining a copy",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "this permission notice shall be included in all copies",
        ],
        "grant": [
            "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit licen(?:[cs]e|sing)", "licensed under (?:the )?mit",
            "under (?:the )?(?:terms of (?:the )?)?mit(?: style| open source)? licen[cs]e(?: terms)?", "subject to the (?:terms of the )?mit licen[cs]e", "(?:dual )?licensed (?:as )?mit", "mit licensed",
            "under the expat licen[cs]e",
        ],
        "name": ["the mit licen[cs]e", "mit licen[cs]e", "mit x11 licen[cs]e", "x11 licen[cs]e", "expat licen[cs]e", "massachusetts institute of technology licen[cs]e x11"],
    },
    "mit-0": {
        "keys": ("mit 0", "mit no attribution"),
        "spdx": ["spdx license identifier mit 0"],
        "name": ["mit no attribution(?: licen[cs]e)?", "mit 0 licen[cs]e", "licensed under mit 0"],
    },
    "apache-2": {
        "keys": ("apache",),
        "spdx": ["spdx license identifier apache 2 0", "license apache 2 0", "licensed apache 2 0"],
        "text": [
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
            "apache license version 2 0 january 2004", "(?:http|https) www apache org licenses license 2 0", "(?:www )?apache org licenses license 2 0(?: txt| html)?",
        ],
        "grant": [
            "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache (?:software )?licen[cs]e(?: version)? (?:v )?(?:2|v2)(?: 0)?",
            "under (?:the )?(?:terms of the )?apache (?:software )?licen[cs]e(?: version)? (?:2|v2)(?: 0)?", "(?:licensed|released|available) under apache (?:2|v2)(?: 0)?", "under the apache 2(?: 0)? licen[cs]e",
        ],
        "name": ["apache (?:software )?licen[cs]e(?: version)? (?:2|v2)(?: 0)?", "apache 2(?: 0)? licen[cs]e", "apache licen[cs]e v 2 0", "apache v2(?: 0)?(?: licen[cs]e)?", "asl 2 0 apache"],
    },
    "apache-1": {
        "keys": ("apache",),
        "spdx": ["spdx license identifier apache 1 [01]"],
        "text": ["this product includes software developed by the apache (?:software foundation|group)"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the |an )?(?:terms of the )?apache (?:software )?licen[cs]e(?: version)? 1 [01]"],
        "name": ["apache (?:software )?licen[cs]e(?: version)? 1 [01]", "apache 1 [01] licen[cs]e"],
    },
    "apache": {
        "keys": ("apache",),
        "grant": ["(?:licensed|released|distributed|available) under (?:the |an )?(?:terms of the )?apache licen[cs]e", "apache licensed"],
        "name": ["apache (?:software |public )?licen[cs]e"],
    },
    "bsd-2": {
        "keys": ("bsd",),
        "spdx": ["spdx license identifier bsd 2 clause", "license bsd 2 clause"],
        "grant": ["under (?:the )?(?:terms of the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?"],
        "name": ["simplified bsd(?: licen[cs]e)?", "bsd 2 clause(?: licen[cs]e)?", "2 clause bsd(?: licen[cs]e)?", "two clause bsd(?: licen[cs]e)?", "freebsd licen[cs]e"],
    },
    "bsd-3": {
        "keys": ("bsd", "redistribution and use in source", "neither the name of"),
        "spdx": ["spdx license identifier bsd 3 clause(?: clear)?", "license bsd 3 clause"],
        "text": [
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            "redistribution and use in source and binary forms with or without modification",
            "neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products",
        ],
        "grant": [
            "under (?:the |a )?(?:terms of the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?",
            "use of this source code is governed by a bsd style licen[cs]e", "(?:licensed|released|distributed|available) under (?:the |a )?bsd(?: style)? licen[cs]e", "bsd licensed",
        ],
        "name": [
            "new bsd(?: licen[cs]e)?", "modified bsd(?: licen[cs]e)?", "revised bsd(?: licen[cs]e)?", "bsd 3 clause(?: licen[cs]e)?", "3 clause bsd(?: licen[cs]e)?", "three clause bsd(?: licen[cs]e)?",
            "bsd style licen[cs]e", "bsd licen[cs]e", "berkeley software distribution bsd licen[cs]e",
        ],
    },
    "bsd-4": {
        "keys": ("bsd", "all advertising materials"),
        "spdx": ["spdx license identifier bsd 4 clause(?: uc)?"],
        "text": ["all advertising materials mentioning features or use of this software must display the following acknowledge?ment"],
        "name": ["original bsd licen[cs]e", "bsd 4 clause(?: licen[cs]e)?", "4 clause bsd(?: licen[cs]e)?", "four clause bsd(?: licen[cs]e)?"],
    },
    "0bsd": {
        "keys": ("0bsd", "zero clause bsd", "bsd zero clause"),
        "spdx": ["spdx license identifier 0bsd"],
        "name": ["zero clause bsd(?: licen[cs]e)?", "bsd zero clause licen[cs]e", "0bsd(?: licen[cs]e)?"],
    },
    "isc": {
        "keys": ("isc ", "permission to use copy modify and or distribute", "permission to use copy modify and distribute"),
        "spdx": ["spdx license identifier isc"],
        "text": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?isc(?: licen[cs]e)?"],
        "name": ["the isc licen[cs]e", "isc licen[cs]e"],
    },
    "gpl-2": {
        "keys": ("gpl", "general public licen"),
        "spdx": ["spdx license identifier gpl 2 0(?: only| or later)?", "license gpl 2 0(?: only| or later)?"],
        "text": [
            "gnu general public license version 2 june 1991", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
            "under the terms of the gnu general public license version 2 as published by the free software foundation",
        ],
        "grant": [
            "(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl ?(?:version |v ?)?(?:2|v2)(?: 0)?",
            "under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e (?:version |v ?)?(?:2|v2)(?: 0)?(?: only| or later)?",
        ],
        "name": ["gnu general public licen[cs]e (?:version |v ?)?(?:2|v2)(?: 0)?(?: only| or later)?", "(?:gnu )?gpl (?:version |v ?)?2(?: 0)?(?: only| or later)?", "(?:gnu )?gplv2", "gpl v2"],
    },
    "gpl-3": {
        "keys": ("gpl", "general public licen"),
        "spdx": ["spdx license identifier gpl 3 0(?: only| or later)?", "license gpl 3 0(?: only| or later)?"],
        "text": [
            "gnu general public license version 3 29 june 2007", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
            "under the terms of the gnu general public license version 3 as published by the free software foundation",
        ],
        "grant": [
            "(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl ?(?:version |v ?)?(?:3|v3)(?: 0)?",
            "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e (?:version |v ?)?(?:3|v3)(?: 0)?(?: only| or later)?",
            "under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e (?:version |v ?)?(?:3|v3)(?: 0)?(?: only| or later)?",
        ],
        "name": ["gnu general public licen[cs]e (?:version |v ?)?(?:3|v3)(?: 0)?(?: only| or later)?", "(?:gnu )?gpl (?:version |v ?)?3(?: 0)?(?: only| or later)?", "(?:gnu )?gplv3", "gpl v3"],
    },
    "gpl": {
        "keys": ("gpl", "general public licen", "this program is free software"),
        "spdx": ["spdx license identifier gpl 1 0(?: only| or later)?"],
        "text": ["this program is free software you can redistribute it and or modify it", "you should have received a copy of the gnu general public license", "as published by the free software foundation gnu general public license"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu general public licen[cs]e|gnu gpl|gpl)", "under the (?:gnu )?gpl", "gpl licensed"],
        "name": ["gnu general public licen[cs]e", "gnu gpl", "gpl compatible", "the gpl", "gpl licen[cs]e"],
    },
    "lgpl-2.1": {
        "keys": ("lgpl", "lesser general public licen", "library general public licen"),
        "spdx": ["spdx license identifier lgpl 2 [01](?: only| or later)?", "license lgpl 2 1(?: only| or later)?"],
        "text": ["gnu lesser general public license version 2 1 february 1999", "gnu library general public license version 2 june 1991"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl) (?:version |v ?)?2(?: [01])?"],
        "name": ["gnu lesser general public licen[cs]e (?:version |v ?)?2 1(?: or later)?", "lgpl (?:version |v ?)?2(?: [01])?(?: or later)?", "lgplv2(?: 1)?", "lgpl v2(?: 1)?", "gnu library general public licen[cs]e"],
    },
    "lgpl-3": {
        "keys": ("lgpl", "lesser general public licen"),
        "spdx": ["spdx license identifier lgpl 3 0(?: only| or later)?", "license lgpl 3 0(?: only| or later)?"],
        "text": ["gnu lesser general public license version 3 29 june 2007"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl) (?:version |v ?)?3(?: 0)?"],
        "name": ["gnu lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: or later)?", "lgpl (?:version |v ?)?3(?: 0)?(?: or later)?", "lgplv3", "lgpl v3"],
    },
    "lgpl": {
        "keys": ("lgpl", "lesser general public licen"),
        "text": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "you should have received a copy of the gnu lesser general public license"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl)"],
        "name": ["gnu lesser general public licen[cs]e", "lesser general public licen[cs]e", "gnu lgpl", "lgpl"],
    },
    "agpl-3": {
        "keys": ("agpl", "affero"),
        "spdx": ["spdx license identifier agpl [13] 0(?: only| or later)?", "license agpl 3 0(?: only| or later)?"],
        "text": ["gnu affero general public license version 3 19 november 2007", "you should have received a copy of the gnu affero general public license"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu affero general public licen[cs]e|gnu agpl|agpl)(?: (?:version |v ?)?(?:3|v3))?"],
        "name": ["gnu affero general public licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?", "affero general public licen[cs]e", "affero gpl", "gnu agpl", "agpl(?: v?3(?: 0)?)?", "agplv3"],
    },
    "mpl-2": {
        "keys": ("mpl", "mozilla public"),
        "spdx": ["spdx license identifier mpl 2 0", "license mpl 2 0"],
        "text": ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:mozilla public licen[cs]e|mpl)(?: (?:version |v ?)?2(?: 0)?)?"],
        "name": ["mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?", "mpl (?:v )?2 0", "mplv2", "mozilla public licen[cs]e"],
    },
    "mpl-1.1": {
        "keys": ("mpl", "mozilla public"),
        "spdx": ["spdx license identifier mpl 1 [01]"],
        "text": ["the contents of this file are subject to the mozilla public license version 1 1"],
        "name": ["mozilla public licen[cs]e (?:version |v ?)?1 [01]", "mpl (?:v )?1 [01]", "mpl 1 1 gpl 2 0 lgpl 2 1"],
    },
    "epl-2": {
        "keys": ("epl ", "eclipse public"),
        "spdx": ["spdx license identifier epl 2 0"],
        "text": ["this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"],
        "name": ["eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?", "epl 2 0", "eclipse public licen[cs]e"],
    },
    "epl-1": {
        "keys": ("epl ", "eclipse public"),
        "spdx": ["spdx license identifier epl 1 0"],
        "text": ["this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?1 0"],
        "name": ["eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?", "epl 1 0"],
    },
    "cddl-1": {
        "keys": ("cddl", "common development and distribution"),
        "spdx": ["spdx license identifier cddl 1 [01]"],
        "text": ["the contents of this file are subject to the terms of the common development and distribution license"],
        "grant": ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?cddl"],
        "name": ["common development and distribution licen[cs]e(?: (?:version |v ?)?1 [01])?", "cddl(?: 1 [01])?"],
    },
    "cc0": {
        "keys": ("cc0", "cc zero", "creative commons zero", "publicdomain zero"),
        "spdx": ["spdx license identifier cc0 1 0"],
        "text": ["creativecommons org publicdomain zero 1 0", "to the extent possible under law the author has waived all copyright cc0", "cc0 1 0 universal"],
        "grant": ["(?:released|dedicated|available|licensed) under (?:the )?(?:terms of )?(?:creative commons )?cc0(?: 1 0)?"],
        "name": ["creative commons zero(?: v?1 0(?: universal)?)?", "cc zero", "cc0(?: 1 0)?"],
    },
    "cc-by": {
        "keys": ("cc by", "creative commons", "creativecommons"),
        "spdx": ["spdx license identifier cc by [1234] 0", "license cc by [1234] 0"],
        "text": ["creativecommons org licenses by [1234] [05]", "licensed under a creative commons attribution [1234] [05] (?:international|unported|generic) licen[cs]e", "this work is licensed under a creative commons attribution licen[cs]e"],
        "grant": ["(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of the )?cc by(?: [1234] [05])?"],
        "name": ["creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", "cc by [1234] [05]", "cc by licen[cs]e"],
    },
    "cc-by-sa": {
        "keys": ("cc by sa", "creative commons", "creativecommons"),
        "spdx": ["spdx license identifier cc by sa [1234] [05]", "license cc by sa [1234] [05]"],
        "text": ["creativecommons org licenses by sa [1234] [05]", "text is available under the creative commons attribution share ?alike licen[cs]e"],
        "grant": ["(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of the )?cc by sa(?: [1234] [05])?"],
        "name": ["creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", "cc by sa(?: [1234] [05])?"],
    },
    "cc-by-nd": {
        "keys": ("cc by nd", "creative commons", "creativecommons"),
        "spdx": ["spdx license identifier cc by nd [1234] [05]"],
        "text": ["creativecommons org licenses by nd [1234] [05]"],
        "name": ["creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", "cc by nd(?: [1234] [05])?"],
    },
    "cc-by-nc": {
        "keys": ("cc by nc", "creative commons", "creativecommons"),
        "spdx": ["spdx license identifier cc by nc [1234] [05]"],
        "text": ["creativecommons org licenses by nc [1234] [05]"],
        "grant": ["(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of the )?cc by nc(?: [1234] [05])?"],
        "name": ["creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", "cc by nc(?: [1234] [05])?"],
    },
    "cc-by-nc-sa": {
        "keys": ("cc by nc sa", "creative commons", "creativecommons"),
        "spdx": ["spdx license identifier cc by nc sa [1234] [05]"],
        "text": ["creativecommons org licenses by nc sa [1234] [05]"],
        "name": ["creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", "cc by nc sa(?: [1234] [05])?"],
    },
    "cc-by-nc-nd": {
        "keys": ("cc by nc nd", "creative commons", "creativecommons"),
        "spdx": ["spdx license identifier cc by nc nd [1234] [05]"],
        "text": ["creativecommons org licenses by nc nd [1234] [05]"],
        "name": ["creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", "cc by nc nd(?: [1234] [05])?"],
    },
    "bsl-1": {
        "keys": ("bsl 1", "boost software"),
        "spdx": ["spdx license identifier bsl 1 0"],
        "text": ["distributed under the boost software license version 1 0", "boost software license version 1 0 august 17th 2003"],
        "name": ["boost software licen[cs]e(?: (?:version |v ?)?1 0)?", "bsl 1 0"],
    },
    "busl-1.1": {
        "keys": ("busl", "business source licen"),
        "spdx": ["spdx license identifier busl 1 1"],
        "text": ["use of this software is governed by the business source license"],
        "name": ["business source licen[cs]e(?: 1 1)?", "busl 1 1"],
    },
    "sspl-1": {
        "keys": ("sspl", "server side public"),
        "spdx": ["spdx license identifier sspl 1 0"],
        "name": ["server side public licen[cs]e(?: (?:version |v ?)?1)?", "sspl(?: v?1(?: 0)?)?"],
    },
    "elastic-2": {
        "keys": ("elastic licen",),
        "spdx": ["spdx license identifier elastic license 2 0", "licensed under the elastic license 2 0"],
        "name": ["elastic licen[cs]e (?:version |v ?)?2(?: 0)?", "elastic licen[cs]e"],
    },
    "commons-clause": {
        "keys": ("commons clause",),
        "text": ["commons clause license condition v 1 0", "the software is provided to you by the licensor under the license as defined below subject to the following condition commons clause"],
        "name": ["commons clause"],
    },
    "polyform": {
        "keys": ("polyform",),
        "spdx": ["spdx license identifier polyform (?:noncommercial|small business) 1 0 0"],
        "name": ["polyform (?:noncommercial|small business|shield|strict|internal use|perimeter|free trial) licen[cs]e(?: 1 0 0)?"],
    },
    "openrail": {
        "keys": ("openrail", "open rail", "responsible ai licen"),
        "name": ["creativeml open ?rail m", "(?:bigscience |bigcode )?openrail m?", "open responsible ai licen[cs]e", "responsible ai licen[cs]e", "openrail(?: licen[cs]e)?"],
    },
    "llama": {
        "keys": ("llama",),
        "name": ["llama (?:2|3|3 [123]) community licen[cs]e(?: agreement)?", "licensed under the llama (?:2|3|3 [123]) community licen[cs]e"],
    },
    "artistic-2": {
        "keys": ("artistic licen", "artistic 2"),
        "spdx": ["spdx license identifier artistic 2 0"],
        "name": ["(?:the )?artistic licen[cs]e (?:version |v ?)?2(?: 0)?", "artistic 2 0"],
    },
    "artistic-1": {
        "keys": ("artistic licen", "artistic 1", "same terms as perl itself"),
        "spdx": ["spdx license identifier artistic 1 0(?: perl| cl8)?"],
        "text": ["you can redistribute it and or modify it under the same terms as perl itself", "under the same terms as perl itself"],
        "name": ["(?:the )?artistic licen[cs]e 1 0", "(?:the )?(?:perl |clarified )?artistic licen[cs]e"],
    },
    "zlib": {
        "keys": ("zlib", "altered source versions must be plainly marked", "libpng"),
        "spdx": ["spdx license identifier zlib", "spdx license identifier libpng(?: 2 0)?"],
        "text": ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
        "name": ["zlib libpng licen[cs]e", "zlib licen[cs]e", "libpng licen[cs]e"],
    },
    "unlicense": {
        "keys": ("unlicen", "unencumbered software"),
        "spdx": ["spdx license identifier unlicense"],
        "text": ["this is free and unencumbered software released into the public domain"],
        "name": ["the unlicense", "unlicense"],
    },
    "wtfpl": {
        "keys": ("wtfpl", "do what the fuck you want to"),
        "spdx": ["spdx license identifier wtfpl"],
        "text": ["you just do what the fuck you want to"],
        "name": ["do what the fuck you want to public licen[cs]e", "wtfpl(?: 2)?"],
    },
    "ofl": {
        "keys": ("ofl ", "open font licen"),
        "spdx": ["spdx license identifier ofl 1 [01](?: rfn| no rfn)?"],
        "text": ["this font software is licensed under the sil open font license version 1 1"],
        "name": ["sil open font licen[cs]e(?: (?:version |v ?)?1 1)?", "open font licen[cs]e", "ofl 1 1"],
    },
    "odbl": {
        "keys": ("odbl", "open database licen"),
        "spdx": ["spdx license identifier odbl 1 0"],
        "text": ["made available under the open database license", "any rights in individual contents of the database are licensed under the database contents license odbl"],
        "name": ["open data commons open database licen[cs]e", "open database licen[cs]e", "odbl(?: 1 0)?"],
    },
    "odc-by": {
        "keys": ("odc by", "open data commons attribution"),
        "spdx": ["spdx license identifier odc by 1 0"],
        "name": ["open data commons attribution licen[cs]e", "odc by(?: 1 0)?"],
    },
    "pddl": {
        "keys": ("pddl 1", "public domain dedication and licen"),
        "spdx": ["spdx license identifier pddl 1 0"],
        "name": ["(?:open data commons )?public domain dedication and licen[cs]e", "pddl 1 0"],
    },
    "gfdl": {
        "keys": ("gfdl", "free documentation licen"),
        "spdx": ["spdx license identifier gfdl 1 [123](?: only| or later)?"],
        "text": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"],
        "name": ["gnu free documentation licen[cs]e(?: (?:version |v ?)?1 [123])?", "gfdl(?: 1 [123])?"],
    },
    "eupl": {
        "keys": ("eupl", "european union public"),
        "spdx": ["spdx license identifier eupl 1 [012]"],
        "text": ["licensed under the eupl version 1 [12]"],
        "name": ["european union public licen[cs]e(?: (?:version |v ?)?1 [12])?", "eupl(?: 1 [12])?"],
    },
    "ms-pl": {
        "keys": ("ms pl", "microsoft public licen"),
        "spdx": ["spdx license identifier ms pl"],
        "name": ["microsoft public licen[cs]e", "ms pl"],
    },
    "ms-rl": {
        "keys": ("ms rl", "microsoft reciprocal licen"),
        "spdx": ["spdx license identifier ms rl"],
        "name": ["microsoft reciprocal licen[cs]e", "ms rl"],
    },
    "psf-2": {
        "keys": ("python software foundation", "psf licen", "psf 2", "python 2 0"),
        "spdx": ["spdx license identifier (?:psf|python) 2 0"],
        "text": ["python software foundation license version 2"],
        "name": ["python software foundation licen[cs]e", "psf licen[cs]e(?: agreement)?"],
    },
    "postgresql": {
        "keys": ("postgresql",),
        "spdx": ["spdx license identifier postgresql"],
        "name": ["postgresql licen[cs]e"],
    },
    "php-3": {
        "keys": ("php licen", "php 3"),
        "spdx": ["spdx license identifier php 3 0[01]?"],
        "text": ["this source file is subject to version 3 01 of the php license"],
        "name": ["php licen[cs]e(?: (?:version |v ?)?3 0[01]?)?"],
    },
    "ruby": {
        "keys": ("ruby",),
        "spdx": ["spdx license identifier ruby"],
        "name": ["ruby licen[cs]e", "under the (?:same )?terms (?:as|of) ruby(?: itself)?"],
    },
    "ncsa": {
        "keys": ("ncsa",),
        "spdx": ["spdx license identifier ncsa"],
        "name": ["university of illinois ncsa open source licen[cs]e", "ncsa open source licen[cs]e"],
    },
    "openssl": {
        "keys": ("openssl",),
        "spdx": ["spdx license identifier openssl"],
        "text": ["this product includes software developed by the openssl project"],
        "name": ["openssl licen[cs]e"],
    },
    "unicode": {
        "keys": ("unicode licen", "unicode inc licen", "unicode dfs", "unicode 3"),
        "spdx": ["spdx license identifier unicode (?:dfs 201[56]|3 0|tou)"],
        "name": ["unicode inc license agreement data files and software", "unicode licen[cs]e(?: v3)?"],
    },
    "icu": {
        "keys": ("icu ",),
        "spdx": ["spdx license identifier icu"],
        "name": ["icu licen[cs]e(?: icu 1 8 1 and later)?"],
    },
    "ipl-1": {
        "keys": ("ibm public licen", "common public licen", "ipl 1", "cpl 1"),
        "spdx": ["spdx license identifier (?:ipl|cpl) 1 0"],
        "name": ["ibm public licen[cs]e(?: version 1 0)?", "common public licen[cs]e(?: (?:version |v ?)?1 0)?"],
    },
    "apsl-2": {
        "keys": ("apple public source", "apsl"),
        "spdx": ["spdx license identifier apsl [12] [012]"],
        "name": ["apple public source licen[cs]e(?: version [12] [012])?"],
    },
    "vim": {
        "keys": ("vim licen", "identifier vim"),
        "spdx": ["spdx license identifier vim"],
        "name": ["vim licen[cs]e"],
    },
    "ogl-uk": {
        "keys": ("ogl uk", "open government licen"),
        "spdx": ["spdx license identifier ogl uk [123] 0"],
        "text": ["contains public sector information licensed under the open government licen[cs]e v[123] 0"],
        "name": ["open government licen[cs]e(?: (?:version |v ?)?[123](?: 0)?)?"],
    },
    "cecill": {
        "keys": ("cecill",),
        "spdx": ["spdx license identifier cecill (?:2 [01]|b|c)"],
        "text": ["governed by the cecill(?: b| c)? license under french law"],
        "name": ["cecill(?: b| c)?(?: 2 [01])?(?: licen[cs]e)?", "licence cecill(?: b| c)?"],
    },
    "public-domain": {
        "keys": ("public domain", "gemeinfrei", "domaine public", "dominio público"),
        "text": ["dedicated to the public domain", "released (?:in|into) the public domain", "placed in the public domain", "(?:is|are) in the public domain", "has been identified as being free of known restrictions public domain", "public domain mark 1 0"],
        "name": ["in the public domain", "gemeinfrei", "dans le domaine public", "en el dominio público"],
    },
    "proprietary": {
        "keys": ("reserved", "proprietary", "confidential", "unauthorized", "end user licen", "eula", "vorbehalten", "réservés", "reservados", "all rights"),
        "text": [
            "unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document|material)(?: via any medium)? is (?:strictly )?prohibited", "this software is the confidential and proprietary information of",
            "no part of this (?:publication|book|document|work) may be reproduced [^ ]+(?: [^ ]+){0,20} all rights", "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
        ],
        "name": ["proprietary and confidential", "confidential and proprietary", "proprietary licen[cs]e", "end user licen[cs]e agreement", "eula"],
    },
    "copyright-notice": {
        "keys": ("copyright", "urheberrecht", "droits d auteur", "derechos de autor"),
        "text": ["copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "(?:c )?copyright by", "protected by copyright(?: law)?", "copyright holders?", "spdx filecopyrighttext copyright"],
        "name": ["urheberrechtlich geschützt", "protégé par (?:le|les) droits d auteur", "protegido por derechos de autor"],
    },
}

#: Phrases that hold the name of a license and are about something else.
OTHER = [
    "[a-z0-9]+ licen[cs]e (?:plates?|numbers?|tags?) ?(?:holders?|frames?|readers?)?", "[a-z0-9]+ licen[cs]e plates?", "(?:the )?mit licen[cs]e plates?", "(?:gaz|gas|auto|station|stations) gpl", "gpl (?:gas|tanks?|autogas|stations?)",
    "mit (?:der |einer |seiner |ihrer |dieser )?lizenz", "(?:driver|driving|fishing|hunting|marriage|pilot|business|liquor) (?:s )?licen[cs]es?", "a licen[cs]e to (?:kill|drive|print money)", "artistic licen[cs]e (?:with|in) (?:the )?(?:story|history|film|facts|novel|plot)",
]
