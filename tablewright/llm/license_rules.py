"""Signature rules for licences, in order; each line is ``priority label | keywords | pattern``.

Patterns run over words joined by single blanks (A-Z in lower case, punctuation gone) and match
whole words. ``<v>`` stands for an optional "version" or "v", ``<l>`` for "license" or
"licence", ``<u>`` for "licensed, released, available or distributed under". A rule runs only
where all of its keywords occur as words. Priority 4 is the wording of a licence or its
identifier, 3 a notice that names version and grant, 2 a name with a version, 1 a name, 0 a
hint that some licence applies.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: The phrases that are always looked for, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

RULES = r"""
4 mit | permission hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
4 mit | software | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
4 mit | portions software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
4 mit-0 | permission deal | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
4 x11 | contained advertising | except as contained in this notice the name of the (?:x consortium|open group)(?: \S+){0,6} shall not be used in advertising
4 isc | permission fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
4 0bsd | permission fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
4 bsd-2-clause | redistributions binary | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer(?: \S+){0,3} redistributions in binary form must reproduce
4 bsd-3-clause | neither endorse | neither the name of(?: \S+){1,12} nor the names of its contributors may be used to endorse or promote products
4 bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
4 bsd-clear | patent granted | no express or implied licenses to any party s patent rights are granted by this license
4 apache-2.0 | compliance | you may not use this file except in compliance with the <l>
4 apache-2.0 | apache | apache <l> version 2 0 january 2004
4 apache-2.0 | perpetual worldwide contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright <l>
4 apache-1.1 | apache | this product includes software developed by the apache software foundation
4 apache-1.0 | apache group | this product includes software developed by the apache group
4 gpl-2.0 | gnu | gnu general public <l> version 2 june 1991
4 gpl-3.0 | gnu | gnu general public <l> version 3 29 june 2007
4 gpl-1.0 | gnu | gnu general public <l> version 1 february 1989
4 gpl | redistribute gnu | this (?:program|file|software|library) is free software you can redistribute it and or modify it under the terms of the gnu general public <l>
4 gpl | gnu received | you should have received a copy of the gnu general public <l>
4 gpl | warranty fitness gnu | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public <l>
4 lgpl-2.0 | gnu library | gnu library general public <l> version 2 june 1991
4 lgpl-2.1 | gnu lesser | gnu lesser general public <l> version 2 1 february 1999
4 lgpl-3.0 | gnu lesser | gnu lesser general public <l> version 3 29 june 2007
4 lgpl | gnu lesser redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public <l>
4 lgpl | gnu lesser received | you should have received a copy of the gnu lesser general public <l>
4 agpl-3.0 | gnu affero | gnu affero general public <l> version 3 19 november 2007
4 agpl | gnu affero redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public <l>
4 agpl | gnu affero received | you should have received a copy of the gnu affero general public <l>
4 gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation <l>
4 gfdl-1.1 | gnu documentation | gnu free documentation <l> version 1 1 march 2000
4 gfdl-1.2 | gnu documentation | gnu free documentation <l> version 1 2 november 2002
4 gfdl-1.3 | gnu documentation | gnu free documentation <l> version 1 3 3 november 2008
4 mpl-1.1 | mozilla contents | the contents of this file are subject to the mozilla public <l> version 1 1
4 mpl-1.0 | mozilla contents | the contents of this file are subject to the mozilla public <l> version 1 0
4 mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public <l> v 2 0
4 mpl-2.0 | incompatible | this source code form is incompatible with secondary licenses
4 epl-1.0 | eclipse accompanying | the accompanying program is provided under the terms of this eclipse public <l>
4 epl-1.0 | eclipse v10 | available at http www eclipse org legal epl v10 html
4 epl-2.0 | eclipse epl | available at https? www eclipse org legal epl 2 0
4 cddl-1.0 | file | the contents of this file are subject to the terms of the common development and distribution <l>
4 unlicense | unencumbered | this is free and unencumbered software released into the public domain
4 unlicense | anyone | anyone is free to copy modify publish use compile sell or distribute this software
4 wtfpl | what public | do what the (?:fuck|f ck) you want to public <l>
4 zlib | misrepresented origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
4 zlib | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented
4 bsl-1.0 | boost | boost software <l> version 1 0 august 17th 2003
4 bsl-1.0 | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
4 artistic-1.0 | document conditions | the intent of this document is to state the conditions under which a package may be copied
4 artistic-2.0 | artistic | the artistic <l> 2 0 copyright c 2000 2006
4 ofl-1.1 | sil | sil open font <l> version 1 1 26 february 2007
4 ofl-1.1 | font reserved | the font software may be modified(?: \S+){0,30} reserved font name
4 python-2.0 | software foundation | python software foundation <l> version 2
4 python-2.0 | agreement foundation | this <l> agreement is between the python software foundation
4 postgresql | distribute documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
4 openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
4 ssleay | eric young | this product includes cryptographic software written by eric young
4 php-3.01 | php | this product includes php(?: software)? freely available from
4 curl | daniel stenberg | copyright c 1996 \d{4} daniel stenberg
4 ntp | suitability | makes no representations about the suitability of this software for any purpose it is provided as is without express or implied warranty
4 ncsa | names | neither the names of(?: \S+){1,20} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
4 w3c | permission | permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty
4 icu | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
4 json | software good evil | the software shall be used for good not evil
4 beerware | beer buy | if we meet some day and you think this stuff is worth it you can buy me a beer
4 cc0-1.0 | affirmer waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
4 cc0-1.0 | dedicated waiving | dedicated the work to the public domain by waiving
4 cc0-1.0 | waived neighboring | waived all copyright and related or neighboring rights
4 cc-by | share adapt attribution | you are free to share(?: \S+){0,20} adapt(?: \S+){0,30} attribution
4 cc-by-nc | material purposes | you may not use the material for commercial purposes
4 cc-by-sa | remix | if you remix transform or build upon the material you must distribute your contributions under the same <l>
4 cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
4 odbl-1.0 | database | this (?:\S+ )?database is made available under the open database <l>
4 pddl-1.0 | database | this (?:\S+ )?database is made available under the public domain dedication and <l>
4 odc-by-1.0 | database | this (?:\S+ )?database is made available under the open data commons attribution <l>
4 sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service
4 elastic-2.0 | managed | you may not provide the software to third parties as a hosted or managed service
4 bsl-1.1 | change date | effective on the change date(?: \S+){0,40} change <l>
4 polyform-nc-1.0 | polyform noncommercial | polyform noncommercial <l> 1 0 0
4 polyform-sb-1.0 | polyform business | polyform small business <l> 1 0 0
4 rail-m | restrictions | use based restrictions as referenced in paragraph 5
4 llama-community | llama community | llama(?: \d)* community <l> agreement
4 gemma | gemma | gemma is provided under and subject to the gemma terms of use
4 ms-pl | accept | this <l> governs use of the accompanying software if you use the software you accept this <l>
4 vim | vim | you can use and copy(?: \S+){0,12} vim(?: \S+){0,20} uganda
4 ogl-uk-3.0 | government information | contains public sector information licensed under the open government <l> v ?3 0
4 ogl-uk-2.0 | government information | contains public sector information licensed under the open government <l> v ?2 0
4 etalab-2.0 | ouverte licence | licence ouverte(?: open licence)? <v>2 0
4 apache-2.0 | spdx apache | spdx license identifier apache 2 0
4 mit | spdx mit | spdx license identifier mit
4 gpl-2.0-only | spdx gpl | spdx license identifier gpl 2 0(?: only)?
4 gpl-2.0-or-later | spdx gpl later | spdx license identifier gpl 2 0 or later
4 gpl-3.0-only | spdx gpl | spdx license identifier gpl 3 0(?: only)?
4 gpl-3.0-or-later | spdx gpl later | spdx license identifier gpl 3 0 or later
4 lgpl-2.1 | spdx lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
4 lgpl-3.0 | spdx lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
4 agpl-3.0 | spdx agpl | spdx license identifier agpl 3 0(?: only| or later)?
4 bsd-2-clause | spdx bsd | spdx license identifier bsd 2 clause
4 bsd-3-clause | spdx bsd | spdx license identifier bsd 3 clause
4 isc | spdx isc | spdx license identifier isc
4 mpl-2.0 | spdx mpl | spdx license identifier mpl 2 0
4 epl-2.0 | spdx epl | spdx license identifier epl 2 0
4 cc0-1.0 | spdx cc0 | spdx license identifier cc0 1 0
4 unlicense | spdx unlicense | spdx license identifier unlicense
4 other-spdx | spdx identifier | spdx license identifier \S+
3 apache-2.0 | apache under | <u> the apache <l> <v>2(?: 0)?
3 apache | apache under | <u> (?:the |an )?apache(?: <l>)?
3 mit | mit under | <u> (?:the |an )?(?:terms of the )?mit <l>
3 mit | mit under | <u> (?:the )?mit
3 gpl-2.0 | under | <u> (?:the )?(?:gnu )?gpl ?<v>2(?: 0)?
3 gpl-3.0 | under | <u> (?:the )?(?:gnu )?gpl ?<v>3(?: 0)?
3 gpl-2.0 | gnu general under | <u> the (?:terms of the )?gnu general public <l> <v>2(?: 0)?
3 gpl-3.0 | gnu general under | <u> the (?:terms of the )?gnu general public <l> <v>3(?: 0)?
3 gpl | gnu under | <u> (?:the )?(?:terms of the )?gnu (?:general public <l>|gpl)
3 lgpl | lgpl under | <u> (?:the )?(?:gnu )?lgpl
3 lgpl | gnu lesser under | <u> the (?:terms of the )?gnu lesser general public <l>
3 agpl | agpl under | <u> (?:the )?(?:gnu )?agpl
3 agpl | gnu affero under | <u> the (?:terms of the )?gnu affero general public <l>
3 bsd-3-clause | bsd under | <u> (?:the |a )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: <l>)?
3 bsd-2-clause | under | <u> (?:the |a )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: <l>)?
3 bsd | bsd under | <u> (?:the |a )?bsd(?: style)? <l>
3 isc | isc under | <u> the isc <l>
3 mpl-2.0 | mozilla under | <u> the mozilla public <l> <v>2(?: 0)?
3 mpl | mozilla under | <u> the mozilla public <l>
3 epl | eclipse under | <u> the eclipse public <l>
3 cddl | cddl under | <u> the cddl
3 unlicense | unlicense under | <u> the unlicense
3 zlib | zlib under | <u> the zlib(?: libpng)? <l>
3 bsl-1.0 | boost under | <u> the boost software <l>
3 artistic | artistic under | <u> the (?:perl )?artistic <l>
3 wtfpl | wtfpl under | <u> the wtfpl
3 ofl-1.1 | sil under | <u> the sil open font <l>
3 odbl-1.0 | under | <u> the (?:open database <l>|odbl)
3 gfdl | under | <u> the (?:gnu free documentation <l>|gfdl)
3 cc-by-4.0 | cc under | <u> (?:a |the )?cc by 4 0
3 cc-by-3.0 | cc under | <u> (?:a |the )?cc by 3 0
3 cc-by-sa | cc under sa | <u> (?:a |the )?cc by sa
3 cc-by-nc | cc under nc | <u> (?:a |the )?cc by nc
3 cc-by-nd | cc under nd | <u> (?:a |the )?cc by nd
3 cc0-1.0 | cc0 under | <u> (?:the )?cc0
3 cc-by-4.0 | creative attribution under | <u> (?:a |the )?creative commons attribution 4 0
3 cc-by-3.0 | creative attribution under | <u> (?:a |the )?creative commons attribution 3 0
3 cc-by-sa | creative under | <u> (?:a |the )?creative commons attribution share ?alike
3 cc-by-nc | creative under | <u> (?:a |the )?creative commons attribution non ?commercial
3 cc-by-nd | creative under | <u> (?:a |the )?creative commons attribution no ?deriv(?:ative)?s
3 cc | creative under | <u> (?:a |the )?creative commons
3 proprietary | under | <u> (?:a |the )?(?:proprietary|commercial) <l>
3 eula | agree | you agree to (?:be bound by )?the terms of this (?:end user <l>|eula)
3 public-domain | public domain | (?:released|dedicated|placed) (?:in|into|to) the public domain
2 apache-2.0 | apache | apache(?: software)?(?: <l>)? <v>2(?: 0)?
2 apache-2.0 | apache | apache org licenses license 2 0(?: html| txt)?
2 apache-1.1 | apache | apache(?: software)? <l> <v>1 1
2 apache-1.0 | apache | apache(?: software)? <l> <v>1 0
2 apache-2.0 | asl | asl <v>2 0
2 gpl-2.0 | gpl | gpl <v>2(?: 0)?(?: only)?
2 gpl-2.0 | gplv2 | gplv2
2 gpl-2.0-or-later | gplv2 later | gplv2 or (?:any )?later
2 gpl-2.0-or-later | gpl later | gpl <v>2(?: 0)? or (?:any |at your option any )?later
2 gpl-2.0 | gnu general | gnu general public <l> <v>2(?: 0)?
2 gpl-2.0-or-later | gnu later option | gnu general public <l>(?: as published by the free software foundation)?(?: either)? version 2(?: of the <l>)? or at your option any later version
2 gpl-3.0 | gpl | gpl <v>3(?: 0)?(?: only)?
2 gpl-3.0 | gplv3 | gplv3
2 gpl-3.0-or-later | gplv3 later | gplv3 or (?:any )?later
2 gpl-3.0-or-later | gpl later | gpl <v>3(?: 0)? or (?:any |at your option any )?later
2 gpl-3.0 | gnu general | gnu general public <l> <v>3(?: 0)?
2 gpl-3.0-or-later | gnu later option | gnu general public <l>(?: as published by the free software foundation)?(?: either)? version 3(?: of the <l>)? or at your option any later version
2 gpl-1.0 | gnu general | gnu general public <l> <v>1(?: 0)?
2 gpl-classpath | classpath | gpl(?: \S+){0,3} with classpath exception
2 gpl-3.0 | gnu licenses gpl | gnu org licenses gpl 3 0(?: \S+)?
2 gpl-2.0 | gnu licenses gpl | gnu org licenses (?:old licenses )?gpl 2 0(?: \S+)?
2 lgpl-2.1 | lgpl | lgpl <v>2 1
2 lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
2 lgpl-2.0 | lgpl | lgpl <v>2 0
2 lgpl-3.0 | lgpl | lgpl <v>3(?: 0)?
2 lgpl-3.0 | lgplv3 | lgplv3
2 lgpl-2.1 | gnu lesser | gnu lesser general public <l> <v>2 1
2 lgpl-3.0 | gnu lesser | gnu lesser general public <l> <v>3(?: 0)?
2 lgpl-2.0 | gnu library | gnu library general public <l> <v>2(?: 0)?
2 agpl-3.0 | agpl | agpl <v>3(?: 0)?
2 agpl-3.0 | agplv3 | agplv3
2 agpl-3.0 | affero | (?:gnu )?affero general public <l> <v>3(?: 0)?
2 agpl-1.0 | affero | affero general public <l> <v>1(?: 0)?
2 gfdl-1.3 | gfdl | gfdl <v>1 3
2 gfdl-1.2 | gfdl | gfdl <v>1 2
2 gfdl-1.3 | gnu documentation | gnu free documentation <l> <v>1 3
2 gfdl-1.2 | gnu documentation | gnu free documentation <l> <v>1 2
2 bsd-2-clause | bsd clause | (?:bsd 2 clause|2 clause bsd)(?: <l>)?
2 bsd-3-clause | bsd clause | (?:bsd 3 clause|3 clause bsd)(?: <l>)?
2 bsd-4-clause | bsd clause | (?:bsd 4 clause|4 clause bsd)(?: <l>)?
2 bsd-2-clause | bsd simplified | simplified bsd <l>
2 bsd-3-clause | bsd new | new bsd <l>
2 bsd-3-clause | bsd revised | revised bsd <l>
2 bsd-3-clause | bsd modified | modified bsd <l>
2 0bsd | 0bsd | 0bsd
2 0bsd | bsd zero clause | zero clause bsd(?: <l>)?
2 mpl-1.1 | mpl | mpl <v>1 1
2 mpl-2.0 | mpl | mpl <v>2(?: 0)?
2 mpl-1.1 | mozilla | mozilla public <l> <v>1 1
2 mpl-2.0 | mozilla | mozilla public <l> <v>2(?: 0)?
2 epl-1.0 | epl | epl <v>1(?: 0)?
2 epl-2.0 | epl | epl <v>2(?: 0)?
2 epl-1.0 | eclipse | eclipse public <l> <v>1(?: 0)?
2 epl-2.0 | eclipse | eclipse public <l> <v>2(?: 0)?
2 edl-1.0 | eclipse distribution | eclipse distribution <l>(?: <v>1 0)?
2 eupl-1.1 | eupl | eupl <v>1 1
2 eupl-1.2 | eupl | eupl <v>1 2
2 eupl | european union public | european union public licen[cs]e(?: <v>1 [12])?
2 cecill-2.1 | cecill | cecill <v>2 1
2 cecill-b | cecill b | cecill b
2 cecill-c | cecill c | cecill c
2 cddl-1.0 | cddl | cddl <v>1 0
2 cddl-1.1 | cddl | cddl <v>1 1
2 cpl-1.0 | common public | common public <l> <v>1 0
2 ipl-1.0 | ibm public | ibm public <l>(?: <v>1 0)?
2 osl-3.0 | osl | osl <v>3 0
2 osl | open software | open software <l> <v>\d 0
2 afl-3.0 | academic free | academic free <l> <v>3 0
2 ms-pl | microsoft public | microsoft public <l>
2 ms-rl | microsoft reciprocal | microsoft reciprocal <l>
2 artistic-2.0 | artistic | artistic <l> <v>2(?: 0)?
2 artistic-1.0 | artistic | artistic <l> <v>1(?: 0)?
2 bsl-1.0 | boost | boost software <l> <v>1(?: 0)?
2 bsl-1.1 | business source | business source <l> <v>1 1
2 ofl-1.1 | ofl | ofl <v>1 1
2 ofl-1.1 | sil font | sil open font <l>(?: <v>1 1)?
2 zpl-2.1 | zope | zope public <l> <v>2 1
2 psf-2.0 | psf | psf <v>2(?: 0)?
2 php-3.01 | php | php <l> <v>3 01
2 ruby | ruby | ruby <l>
2 upl-1.0 | universal permissive | universal permissive <l>(?: <v>1 0)?
2 mulan-2.0 | mulan psl | mulan psl <v>2
2 vsl-1.0 | vovida | vovida software <l>
2 sspl-1.0 | server side public | server side public <l>(?: <v>1)?
2 elastic-2.0 | elastic | elastic <l> <v>2(?: 0)?
2 cc-by-4.0 | cc by | cc by 4 0
2 cc-by-3.0 | cc by | cc by 3 0
2 cc-by-2.5 | cc by | cc by 2 5
2 cc-by-2.0 | cc by | cc by 2 0
2 cc-by-sa-4.0 | cc by sa | cc by sa 4 0
2 cc-by-sa-3.0 | cc by sa | cc by sa 3 0
2 cc-by-sa-2.5 | cc by sa | cc by sa 2 5
2 cc-by-nc-4.0 | cc by nc | cc by nc 4 0
2 cc-by-nc-3.0 | cc by nc | cc by nc 3 0
2 cc-by-nd-4.0 | cc by nd | cc by nd 4 0
2 cc-by-nd-3.0 | cc by nd | cc by nd 3 0
2 cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
2 cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
2 cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
2 cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
2 cc-by-4.0 | creativecommons by | creativecommons org licenses by 4 0
2 cc-by-3.0 | creativecommons by | creativecommons org licenses by 3 0
2 cc-by-sa-4.0 | creativecommons by sa | creativecommons org licenses by sa 4 0
2 cc-by-sa-3.0 | creativecommons by sa | creativecommons org licenses by sa 3 0
2 cc-by-nc-4.0 | creativecommons by nc | creativecommons org licenses by nc 4 0
2 cc-by-nd-4.0 | creativecommons by nd | creativecommons org licenses by nd 4 0
2 cc-by-nc-sa-4.0 | creativecommons by nc sa | creativecommons org licenses by nc sa 4 0
2 cc-by-nc-nd-4.0 | creativecommons by nc nd | creativecommons org licenses by nc nd 4 0
2 cc0-1.0 | creativecommons publicdomain zero | creativecommons org publicdomain zero 1 0
2 pdm-1.0 | creativecommons publicdomain mark | creativecommons org publicdomain mark 1 0
2 cc0-1.0 | cc0 | cc0 1 0
2 cc-by-4.0 | creative attribution | creative commons attribution 4 0
2 cc-by-3.0 | creative attribution | creative commons attribution 3 0
2 cc-by-sa-4.0 | creative attribution | creative commons attribution share ?alike 4 0
2 cc-by-sa-3.0 | creative attribution | creative commons attribution share ?alike 3 0
2 cc-by-nc-4.0 | creative attribution | creative commons attribution non ?commercial 4 0
2 cc-by-nd-4.0 | creative attribution | creative commons attribution no ?derivatives 4 0
2 cc-by-nc-sa-4.0 | creative attribution | creative commons attribution non ?commercial share ?alike 4 0
2 cc-by-nc-nd-4.0 | creative attribution | creative commons attribution non ?commercial no ?derivatives 4 0
1 apache | asf | asf <l>
1 mit | expat | expat <l>
1 mit | opensource mit | opensource org licenses mit
1 x11 | x11 | x11 <l>
1 gpl | gpl | gpl
1 gpl | gnu gpl | gnu gpl
1 gpl | gnu copyleft | gnu copyleft
1 lgpl | lgpl | (?:gnu )?lgpl
1 lgpl | gnu lesser | gnu lesser general public <l>
1 lgpl | gnu library public | gnu library general public <l>
1 agpl | agpl | (?:gnu )?agpl
1 agpl | affero | (?:gnu )?affero general public <l>
1 gfdl | gfdl | gfdl
1 gfdl | gnu documentation | gnu free documentation <l>
1 bsd | bsd | bsd(?: style| like)? <l>
1 bsd | bsd licensed | bsd licensed
1 mit | mit licensed | mit licensed
1 apache | apache licensed | apache licensed
1 gpl | gpl licensed | gpl licensed
1 isc | isc | isc <l>
1 mpl | mozilla public | mozilla public <l>
1 epl | eclipse public | eclipse public <l>
1 cpl-1.0 | common public | common public <l>
1 eupl | eupl | eupl
1 cecill | cecill | cecill
1 cddl | cddl | cddl
1 cddl | common development distribution | common development and distribution <l>
1 osl | osl | osl <l>
1 afl | academic free | academic free <l>
1 artistic | artistic | artistic <l>
1 unlicense | unlicense | (?:the )?unlicense
1 wtfpl | wtfpl | wtfpl
1 zlib | zlib | zlib(?: libpng)? <l>
1 bsl-1.0 | boost | boost(?: software)? <l>
1 zpl | zope public | zope public <l>
1 python-2.0 | python foundation | python software foundation <l>
1 php | php | php <l>
1 openssl | openssl | openssl <l>
1 ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? <l>
1 odbl | odbl | odbl
1 odbl | open database | open database <l>
1 odc | open data commons | open data commons
1 ogl-uk | open government | open government licen[cs]e
1 cc-by-sa | cc by sa | cc by sa
1 cc-by-nc | cc by nc | cc by nc
1 cc-by-nd | cc by nd | cc by nd
1 cc-by-nc-sa | cc by nc sa | cc by nc sa
1 cc-by-nc-nd | cc by nc nd | cc by nc nd
1 cc0-1.0 | cc0 | cc0
1 cc | creative commons | creative commons(?: <l>)?
1 cc-by | creative attribution | creative commons attribution(?: <l>)?
1 openrail | openrail | (?:\S+ )?openrail(?: m)?
1 rail | responsible ai | responsible ai <l>
1 beerware | beerware | beerware(?: <l>)?
1 sspl-1.0 | sspl | sspl
1 bsl-1.1 | busl | busl
1 fsl | functional source | functional source <l>
1 copyleft | copyleft | copyleft
1 public-domain | public domain | public domain
1 eula | eula | eula
1 eula | end user | end user <l>(?: agreement)?
1 shareware | shareware | shareware
1 freeware | freeware | freeware
1 crown-copyright | crown copyright | crown copyright
0 all-rights-reserved | rights reserved | all rights reserved
0 all-rights-reserved | droits | tous droits r\S+serv\S+s
0 all-rights-reserved | rechte | alle rechte vorbehalten
0 all-rights-reserved | derechos | todos los derechos reservados
0 copyright | copyright | copyright (?:c )?(?:19|20)\d\d
0 copyright | copyright | copyright ©
0 copyright | © | © (?:19|20)\d\d
0 some-license | licensed under | licensed under
0 some-license | agreement | <l> agreement
0 some-license | terms | under the terms of (?:the|this) <l>
0 some-license | open source | open source <l>
0 no-license | unlicensed | unlicensed
0 no-redistribution | permission | (?:may|must) not be (?:reproduced|copied|redistributed)(?: \S+){0,6} without(?: \S+){0,4} permission
0 confidential | confidential proprietary | confidential and proprietary
"""

_MACROS = {"<v>": "(?:version |v )?v?", "<l>": "licen[cs]e", "<u>": "(?:licensed|released|available|distributed|published|provided) under"}


class Rule(NamedTuple):
    priority: int
    label: str
    keywords: frozenset[bytes]
    pattern: re.Pattern[bytes]
    base: bool


def _rule(priority: int, label: str, keywords: str, pattern: str, base: bool = False) -> Rule:
    for name, text in _MACROS.items():
        pattern = pattern.replace(name, text)
    # before and after a match stand a blank or the ends of the text
    whole = re.compile(b"(?<![^ ])(?:" + pattern.encode() + b")(?![^ ])")
    return Rule(priority, label, frozenset(k.encode() for k in keywords.split()), whole, base)


def parse(text: str = RULES) -> list[Rule]:
    """The base phrases, then the rules in their order."""
    rules = [_rule(2, label, phrase, phrase, True) for phrase, label in BASE]
    for line in text.strip().splitlines():
        head, keywords, pattern = (part.strip() for part in line.split(" | "))
        priority, label = head.split(" ", 1)
        rules.append(_rule(int(priority), label, keywords, pattern))
    return rules
