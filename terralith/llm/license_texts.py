"""Hand-written signatures of licence bodies, notices, clauses, addresses and tags.

Each is a pattern over a text's lower-cased words, one space between them, and says what a licence text or notice says
without naming it in a usual way.  Fixed values, in the order of their labels.
"""

SIGNATURES = {
    "mit": """
permission is hereby granted free of charge to any person obtaining a copy
to deal in the software without restriction including without limitation the rights
the above copyright notice and this permission notice shall be included in all copies
the software is provided as is without warranty of any kind
in no event shall the authors or copyright holders be liable for any claim damages or other liability
opensource org licenses? mit
choosealicense com licenses mit
mit x11 license
""",
    "mit-0": """
mit no attribution
without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
""",
    "apache": """
you may not use this file except in compliance with the license
(?:https? )?www apache org licenses license 2 0
you may obtain a copy of the license at (?:https? )?www apache org
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
see the license for the specific language governing permissions and limitations under the license
licensed to the apache software foundation asf under one or more contributor license agreements
grant of patent license subject to the terms and conditions of this license each contributor hereby grants
you must give any other recipients of the work or derivative works a copy of this license
this product includes software developed by the apache group for use in the apache http server project
opensource org licenses? apache 2 0
""",
    "bsd": """
redistribution and use in source and binary forms with or without modification are permitted
redistributions of source code must retain the above copyright notice this list of conditions
redistributions in binary form must reproduce the above copyright notice this list of conditions
this software is provided by the (?:\\w+ ){1,6}and contributors as is and any express or implied warranties
in no event shall the (?:\\w+ ){1,6}(?:and|or) contributors be liable for any direct indirect incidental special exemplary
use of this source code is governed by a bsd style license
""",
    "bsd-2-clause": """
opensource org licenses? bsd 2 clause
simplified bsd license
freebsd (?:license|documentation license)
""",
    "bsd-3-clause": """
neither the name of (?:\\w+ ){1,8}nor the names of its contributors
may be used to endorse or promote products derived from this software without specific prior written permission
opensource org licenses? bsd 3 clause
(?:new|modified|revised) bsd license
""",
    "bsd-4-clause": """
all advertising materials mentioning features or use of this software must display the following acknowledg
(?:original|old) bsd license
this product includes software developed by the university of california berkeley
""",
    "0bsd": """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
zero clause bsd
free public license 1 0 0
""",
    "bsd-patent": """
redistribution and use of this software in (?:\\w+ ){1,4}subject to the additional patent grant
bsd 2 clause plus patent license
""",
    "gpl": """
free software you can redistribute it and or modify it under the terms of
you should have received a copy of the gnu general public license
(?:https? )?www gnu org (?:licenses gpl|copyleft gpl)
this program is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
either version (?:2|3) of the license or at your option any later version
free software foundation inc 59 temple place
free software foundation inc 51 franklin street
the gnu general public license is a free copyleft license for software
everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
you may convey verbatim copies of the program s source code as you receive it
opensource org licenses? gpl
""",
    "gpl-2.0": """
gnu general public license version 2 june 1991
this general public license does not permit incorporating your program into proprietary programs
under the terms of the gnu general public license version 2 only
module license gpl v2
""",
    "gpl-3.0": """
gnu general public license version 3 29 june 2007
to protect your rights we need to prevent others from denying you these rights or asking you to surrender the rights
installation information for a user product means any methods procedures authorization keys
""",
    "gpl-exception": """
gcc runtime library exception
classpath exception
as a special exception you may create a larger work that contains part or all of the bison parser
as a special exception the copyright holders of this library give you permission to link
openssl linking exception
linking this library statically or dynamically with other modules is making a combined work
autoconf configure script exception
""",
    "lgpl": """
you should have received a copy of the gnu (?:lesser|library) general public license
(?:https? )?www gnu org licenses lgpl
permits linking it with non free programs
a work that uses the library in isolation is not a derivative work of the library
combined work is a work produced by combining or linking an application with the library
opensource org licenses? lgpl
""",
    "agpl": """
you should have received a copy of the gnu affero general public license
(?:https? )?www gnu org licenses agpl
your modified version must prominently offer all users interacting with it remotely through a computer network
specifically designed to ensure cooperation with the community in the case of network server software
""",
    "mpl": """
this source code form is subject to the terms of the mozilla public license
if a copy of the mpl was not distributed with this file you can obtain one at
(?:https? )?(?:www )?mozilla org mpl
this source code form is incompatible with secondary licenses
the contents of this file are subject to the mozilla public license version
incompatible with secondary licenses as defined by the mozilla public license
""",
    "epl": """
this program and the accompanying materials are made available under the terms of the eclipse public license
(?:https? )?www eclipse org legal epl
the accompanying program is provided under the terms of this eclipse public license
""",
    "edl": """
eclipse distribution license
(?:https? )?www eclipse org org documents edl
""",
    "cddl": """
the contents of this file are subject to the terms of the common development and distribution license
you can obtain a copy of the license at usr src opensolaris license
when distributing covered code include this cddl header in each file
(?:https? )?(?:www )?opensolaris org os licensing
""",
    "cpl": """
the accompanying program is provided under the terms of this common public license
any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
""",
    "ipl": """
ibm public license
the accompanying program is provided under the terms of this ibm public license
""",
    "eupl": """
licensed under the eupl
european union public licence v ?1
licence publique de l union europeenne
joinup ec europa eu (?:\\w+ ){0,3}eupl
""",
    "cecill": """
cecill (?:b |c )?(?:free software )?license
governed by the cecill
cecill info licences
ce logiciel est regi par la licence cecill
""",
    "artistic": """
the intent of this document is to state the conditions under which a package may be copied
same terms as perl itself
it under the same terms as the perl 5 programming language system
this license establishes the terms under which a given free software package may be copied modified distributed
clarified artistic license
""",
    "bsl-1.0": """
permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
distributed under the boost software license
(?:https? )?www boost org license 1 0 txt
""",
    "busl-1.1": """
business source license
licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
the change date or the fourth anniversary of the first publicly available distribution
additional use grant
""",
    "sspl": """
server side public license
if you make the functionality of the program or a modified version available to third parties as a service
""",
    "elastic": """
elastic license (?:2 0|v2|agreement)
you may not provide the software to third parties as a hosted or managed service
""",
    "commons-clause": """
commons clause license condition
the grant of rights under the license will not include and the license does not grant to you the right to sell the software
""",
    "osl": """
licensed under the open software license
this open software license the license applies to any original work of authorship
""",
    "afl": """
licensed under the academic free license
this academic free license the license applies to any original work of authorship
""",
    "ofl": """
this font software is licensed under the sil open font license
reserved font name
scripts sil org ofl
the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
neither the font software nor any of its individual components in original or modified versions may be sold by itself
""",
    "font-license": """
bitstream vera fonts copyright
ubuntu font licen[cs]e
gust font license
""",
    "isc": """
permission to use copy modify and or distribute this software for any purpose with or without fee
permission to use copy modify and distribute this software for any purpose with or without fee
the author disclaims all warranties with regard to this software
opensource org licenses? isc
""",
    "hpnd": """
permission to use copy modify and distribute this software and its documentation for any purpose and without fee
and that both that copyright notice and this permission notice appear in supporting documentation
historical permission notice and disclaimer
""",
    "x11": """
except as contained in this notice the name of the x consortium shall not be used in advertising
the open group shall not be used in advertising or otherwise to promote the sale use or other dealings
""",
    "ntp": """
permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided
university of delaware not be used in advertising or publicity
""",
    "curl": """
copyright c 1996 (?:\\w+ ){0,4}daniel stenberg
permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
""",
    "zlib": """
this software is provided as is without any express or implied warranty
the origin of this software must not be misrepresented you must not claim that you wrote the original software
altered source versions must be plainly marked as such
this notice may not be removed or altered from any source distribution
""",
    "libpng": """
libpng is distributed (?:\\w+ ){0,6}under the same disclaimer and license
png reference library license
the png reference library is supplied as is
""",
    "ijg": """
this software is based in part on the work of the independent jpeg group
independent jpeg group license
""",
    "libtiff": """
in no event shall sam leffler or silicon graphics be liable
the names of sam leffler and silicon graphics may not be used in any advertising
""",
    "openssl": """
this product includes software developed by the openssl project for use in the openssl toolkit
the names openssl toolkit and openssl project must not be used to endorse or promote products
openssl license
""",
    "ssleay": """
this product includes cryptographic software written by eric young
the implementation was written so as to conform with netscapes ssl
""",
    "openldap": """
openldap public license
the openldap foundation may revise this license from time to time
""",
    "php": """
this product includes php software freely available from
products derived from this software may not be called php
php license version
""",
    "zend": """
zend engine license
this product includes the zend engine freely available at
""",
    "ruby": """
you may distribute the software in object code or binary form provided that you do at least one of the following
same terms as ruby
""",
    "psf": """
psf license agreement for python
python software foundation license version 2
psf hereby grants licensee a nonexclusive royalty free world wide license
beopen python open source license agreement
cnri open source (?:gpl compatible )?license agreement
""",
    "zpl": """
zope public license
the name zope corporation tm must not be used to endorse or promote products
""",
    "tcl": """
this software is copyrighted by the regents of the university of california sun microsystems inc scriptics corporation
tcl tk license
""",
    "vim": """
vim license
there are no restrictions on distributing unmodified copies of vim
""",
    "lppl": """
latex project public license
this work may be distributed and or modified under the conditions of the latex project public license
this work has the lppl maintenance status maintained
(?:https? )?www latex project org lppl
""",
    "unlicense": """
this is free and unencumbered software released into the public domain
anyone is free to copy modify publish use compile sell or distribute this software
unlicense org
in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
""",
    "public-domain": """
(?:released|placed|dedicated) (?:in|into|to) the public domain
this (?:file|work|code|software|program) is (?:hereby )?in the public domain
the author disclaims copyright to this source code
no copyright is claimed
work of the (?:united states|u s) government
may you do good and not evil may you find forgiveness for yourself
""",
    "cc0": """
(?:https? )?creativecommons org publicdomain zero
no rights reserved
the person who associated a work with this deed has dedicated the work to the public domain
affirmer hereby overtly fully permanently irrevocably and unconditionally waives
""",
    "pdm": """
creativecommons org publicdomain mark
public domain mark 1 0
this work has been identified as being free of known restrictions under copyright law
""",
    "cc-by": """
(?:https? )?creativecommons org licenses by(?! nc| nd| sa)
attribution 4 0 international
you are free to share copy and redistribute the material in any medium or format
you must give appropriate credit provide a link to the license and indicate if changes were made
""",
    "cc-by-sa": """
(?:https? )?creativecommons org licenses by sa
attribution share ?alike 4 0 international
if you remix transform or build upon the material you must distribute your contributions under the same license as the original
""",
    "cc-by-nc": """
(?:https? )?creativecommons org licenses by nc(?! nd| sa)
attribution non ?commercial 4 0 international
you may not use the material for commercial purposes
""",
    "cc-by-nd": """
creativecommons org licenses by nd
attribution no ?derivatives 4 0 international
if you remix transform or build upon the material you may not distribute the modified material
""",
    "cc-by-nc-sa": """
creativecommons org licenses by nc sa
attribution non ?commercial share ?alike 4 0 international
""",
    "cc-by-nc-nd": """
creativecommons org licenses by nc nd
attribution non ?commercial no ?derivatives 4 0 international
""",
    "cc-sampling": """
creativecommons org licenses (?:nc )?sampling
""",
    "gfdl": """
permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
with no invariant sections no front cover texts and no back cover texts
(?:https? )?www gnu org (?:licenses|copyleft) fdl
""",
    "odbl": """
made available under the open database license
opendatacommons org licenses odbl
any rights in individual contents of the database are licensed under the database contents license
""",
    "odc-by": """
opendatacommons org licenses by
open data commons attribution license
""",
    "pddl": """
opendatacommons org licenses pddl
public domain dedication and license
""",
    "ogl-uk": """
contains public sector information licensed under the open government licen[cs]e
open government licen[cs]e v ?[123]
nationalarchives gov uk doc open government licence
""",
    "etalab": """
licence ouverte (?:open licence )?(?:version )?[12]
etalab 2 0
""",
    "cdla": """
community data license agreement (?:permissive|sharing)
cdla io (?:permissive|sharing)
""",
    "wtfpl": """
you just do what the fuck you want to
wtfpl net
""",
    "beerware": """
if we meet some day and you think this stuff is worth it you can buy me a beer
the beer ?ware license
""",
    "json": """
the software shall be used for good not evil
json license
""",
    "ms-pl": """
microsoft public license
this license governs use of the accompanying software if you use the software you accept this license
""",
    "ms-rl": """
microsoft reciprocal license
reciprocal grants for any file you distribute that contains code from the software
""",
    "apsl": """
apple public source license
this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license
""",
    "npl": """
netscape public license
(?:https? )?www mozilla org npl
""",
    "qpl": """
q public license
licensed under the qt public license
""",
    "sleepycat": """
redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
sleepycat license
""",
    "watcom": """
sybase open watcom public license
""",
    "nasa": """
nasa open source agreement
""",
    "ecl": """
educational community license
""",
    "ncsa": """
university of illinois ncsa open source license
university of illinois urbana champaign nor the names of its contributors may be used
""",
    "llvm-exception": """
apache license v ?2 0 with llvm exceptions
llvm exceptions to the apache 2 0 license
""",
    "postgresql": """
postgresql (?:licen[cs]e|database management system formerly known as postgres)
in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
""",
    "mulan": """
mulan psl v ?2
licensed under mulan permissive software license
license coscl org cn mulanpsl
""",
    "upl": """
universal permissive license
subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
""",
    "w3c": """
w3c software (?:notice and license|and document notice and license)
by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
""",
    "unicode": """
unicode inc license agreement data files and software
unicode license v ?3
unicode inc hereby grants the right to freely use the information supplied in this file
""",
    "icu": """
icu license icu 1 8 1 and later
""",
    "blueoak": """
blue oak model license
blueoakcouncil org license
""",
    "ethical": """
hippocratic license
anti 996 license
do no harm license
""",
    "openrail": """
(?:creativeml )?open ?rail (?:\\w+ )?license
responsible ai licen[cs]e
you agree not to use the model or derivatives of the model
""",
    "llama": """
llama (?:2|3|3 1|3 2|4) community license agreement
built with (?:meta )?llama
""",
    "gemma": """
gemma is provided under and subject to the gemma terms of use
ai google dev gemma terms
""",
    "polyform": """
polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) license
polyformproject org licenses
""",
    "fair-source": """
functional source license
fair source license
""",
    "non-commercial": """
for non commercial (?:use|purposes|research) only
for academic and non commercial use only
not for commercial use
free for personal use
personal and non commercial use only
for research purposes only
""",
    "evaluation": """
for evaluation purposes only
this is an evaluation copy
trial version license
""",
    "shareware": """
this is shareware
shareware version
freeware license
""",
    "proprietary": """
all rights reserved
proprietary and confidential
unauthorized copying of this file via any medium is strictly prohibited
this software is the confidential and proprietary information of
no part of this (?:publication|work|document|book|software) may be reproduced
end user license agreement
by installing or using the software you agree to be bound by the terms
reverse engineering decompilation or disassembly
you may not reverse engineer decompile or disassemble
use duplication or disclosure by the (?:u s |united states )?government is subject to restrictions
no license express or implied (?:by estoppel or otherwise )?to any intellectual property rights is granted
reproduction or distribution without (?:prior )?written permission is prohibited
this material may not be published broadcast rewritten or redistributed
used (?:by|with) permission of the (?:publisher|author|copyright holder)
""",
    "dual-license": """
this (?:project|software|library|work) is dual licensed
at your option under either of
licensed under either of (?:the )?apache license version 2 0 or (?:the )?mit license
available under both an open source license and a commercial license
commercial licenses? (?:is|are) available
""",
    "see-license": """
see (?:the )?(?:accompanying )?file license (?:txt |md )?for
see license (?:txt|md|file) for (?:details|more information|license information)
please refer to the license file
license information can be found in the license file
""",
    "contributor-agreement": """
developer certificate of origin version 1 1
by making a contribution to this project i certify that
contributor license agreement
""",
}
