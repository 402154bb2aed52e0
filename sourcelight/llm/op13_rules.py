"""Signature rules of the license scan.

One rule a line: keyword ; label ; kind ; pattern. Patterns read texts reduced to lower-case words with one blank between
them, so ``2.0`` is ``2 0`` and ``CC BY-SA`` is ``cc by sa``. A rule is tried only on texts that hold its keyword as a
word. The kind gives the priority, the lines give the order inside a kind.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Kind -> (priority, smaller first; weight of a detection).
KINDS = {"tag": (0, 0.99), "text": (1, 0.97), "notice": (2, 0.95), "name": (3, 0.9), "family": (4, 0.75), "hint": (5, 0.3)}

RULES = r"""
spdx ; mit ; tag ; spdx license identifier mit
spdx ; mit-0 ; tag ; spdx license identifier mit 0
spdx ; apache-2.0 ; tag ; spdx license identifier apache 2 0
spdx ; apache-1.1 ; tag ; spdx license identifier apache 1 1
spdx ; bsd-2-clause ; tag ; spdx license identifier bsd 2 clause
spdx ; bsd-3-clause ; tag ; spdx license identifier bsd 3 clause
spdx ; bsd-4-clause ; tag ; spdx license identifier bsd 4 clause
spdx ; 0bsd ; tag ; spdx license identifier 0bsd
spdx ; isc ; tag ; spdx license identifier isc
spdx ; gpl-2.0-only ; tag ; spdx license identifier gpl 2 0(?: only)?
spdx ; gpl-2.0-or-later ; tag ; spdx license identifier gpl 2 0 or later
spdx ; gpl-3.0-only ; tag ; spdx license identifier gpl 3 0(?: only)?
spdx ; gpl-3.0-or-later ; tag ; spdx license identifier gpl 3 0 or later
spdx ; lgpl-2.1-only ; tag ; spdx license identifier lgpl 2 1(?: only)?
spdx ; lgpl-2.1-or-later ; tag ; spdx license identifier lgpl 2 1 or later
spdx ; lgpl-3.0-only ; tag ; spdx license identifier lgpl 3 0(?: only)?
spdx ; lgpl-3.0-or-later ; tag ; spdx license identifier lgpl 3 0 or later
spdx ; agpl-3.0-only ; tag ; spdx license identifier agpl 3 0(?: only)?
spdx ; agpl-3.0-or-later ; tag ; spdx license identifier agpl 3 0 or later
spdx ; mpl-1.1 ; tag ; spdx license identifier mpl 1 1
spdx ; mpl-2.0 ; tag ; spdx license identifier mpl 2 0
spdx ; epl-1.0 ; tag ; spdx license identifier epl 1 0
spdx ; epl-2.0 ; tag ; spdx license identifier epl 2 0
spdx ; cddl-1.0 ; tag ; spdx license identifier cddl 1 0
spdx ; cc0-1.0 ; tag ; spdx license identifier cc0 1 0
spdx ; cc-by-4.0 ; tag ; spdx license identifier cc by 4 0
spdx ; cc-by-sa-4.0 ; tag ; spdx license identifier cc by sa 4 0
spdx ; unlicense ; tag ; spdx license identifier unlicense
spdx ; zlib ; tag ; spdx license identifier zlib
spdx ; bsl-1.0 ; tag ; spdx license identifier bsl 1 0
spdx ; wtfpl ; tag ; spdx license identifier wtfpl
spdx ; artistic-2.0 ; tag ; spdx license identifier artistic 2 0
spdx ; postgresql ; tag ; spdx license identifier postgresql
spdx ; other-spdx ; hint ; spdx license identifier
granted ; mit ; text ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
notice ; mit ; text ; the above copyright notice and this permission notice (?:\S+ ){0,6}shall be included in all copies or substantial portions of the software
publish ; mit ; text ; without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
redistributions ; bsd-2-clause ; text ; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
binary ; bsd-2-clause ; text ; redistributions in binary form must reproduce the above copyright notice this list of conditions
endorse ; bsd-3-clause ; text ; neither the names? of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
advertising ; bsd-4-clause ; text ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
fee ; isc ; text ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
fee ; hpnd ; text ; permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
compliance ; apache-2.0 ; text ; you may not use this file except in compliance with the license
implied ; apache-2.0 ; text ; distributed on an as is basis without warranties or conditions of any kind either express or implied
patent ; apache-2.0 ; text ; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license
redistribute ; gpl ; text ; you can redistribute it and or modify it under the terms of the gnu general public license
redistribute ; lgpl ; text ; you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
redistribute ; agpl ; text ; you can redistribute it and or modify it under the terms of the gnu affero general public license
merchantability ; gpl ; text ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
merchantability ; lgpl ; text ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license
merchantability ; agpl ; text ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license
verbatim ; gpl ; text ; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
mozilla ; mpl-2.0 ; text ; this source code form is subject to the terms of the mozilla public license v 2 0
mozilla ; mpl-1.1 ; text ; the contents of this file are subject to the mozilla public license version 1 1
eclipse ; epl-1.0 ; text ; made available under the terms of the eclipse public license v1 0
eclipse ; epl-2.0 ; text ; made available under the terms of the eclipse public license (?:v )?2 0
cddl ; cddl-1.0 ; text ; the contents of this file are subject to the terms of the cddl
development ; cddl-1.0 ; text ; the contents of this file are subject to the terms of the common development and distribution license
unencumbered ; unlicense ; text ; this is free and unencumbered software released into the public domain
misrepresented ; zlib ; text ; the origin of this software must not be misrepresented you must not claim that you wrote the original software
boost ; bsl-1.0 ; text ; distributed under the boost software license version 1 0
fuck ; wtfpl ; text ; you just do what the fuck you want to
waived ; cc0-1.0 ; text ; (?:has|have) waived all copyright and related or neighboring rights
warranty ; disclaimer ; hint ; (?:this|the) software is provided as is without (?:any )?(?:express or implied )?warranty(?: of any kind)?
software ; disclaimer ; hint ; this software is provided by (?:\S+ ){1,8}as is
liable ; disclaimer ; hint ; in no event shall (?:\S+ ){1,8}be (?:held )?liable for any
mit ; mit ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?mit license
apache ; apache-2.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?apache license version 2 0
apache ; apache ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?apache license
gnu ; gpl-2.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?gnu (?:gpl|general public license)(?: version)? v?2(?: 0)?
gnu ; gpl-3.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?gnu (?:gpl|general public license)(?: version)? v?3(?: 0)?
gnu ; gpl ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?gnu (?:gpl|general public license)
gnu ; lgpl-2.1 ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?gnu (?:lgpl|lesser general public license)(?: version)? v?2 1
gnu ; lgpl-3.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?gnu (?:lgpl|lesser general public license)(?: version)? v?3(?: 0)?
gnu ; agpl-3.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?gnu (?:agpl|affero general public license)(?: version)? v?3(?: 0)?
bsd ; bsd ; notice ; (?:licensed|released|distributed|published|available|provided) under (?:the|a) (?:terms of the )?bsd(?: style)? license
bsd ; bsd-3-clause ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?(?:bsd 3 clause|3 clause bsd) license
bsd ; bsd-2-clause ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?(?:bsd 2 clause|2 clause bsd) license
isc ; isc ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?isc license
mozilla ; mpl ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?mozilla public license
eclipse ; epl ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?eclipse public license
boost ; bsl-1.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?boost software license
creative ; creative-commons ; notice ; (?:licensed|released|distributed|published|available|provided) under (?:a|the) (?:terms of the )?creative commons(?: \S+){0,4} license
cc ; cc-by-4.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under (?:the )?cc by 4 0
cc ; cc-by-sa-4.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under (?:the )?cc by sa 4 0
cc ; cc-by-nc-4.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under (?:the )?cc by nc 4 0
cc ; cc-by-nd-4.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under (?:the )?cc by nd 4 0
cc ; cc-by-nc-sa-4.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under (?:the )?cc by nc sa 4 0
cc ; cc-by-nc-nd-4.0 ; notice ; (?:licensed|released|distributed|published|available|provided) under (?:the )?cc by nc nd 4 0
perl ; perl ; notice ; under the same terms as perl(?: itself)?
python ; psf ; notice ; under the (?:terms of the )?python(?: software foundation)? license
php ; php ; notice ; subject to version 3 0?1? ?of the php license
apache ; apache-1.0 ; name ; apache(?: software)? license(?: version)? v?1 0
apache ; apache-1.1 ; name ; apache(?: software)? license(?: version)? v?1 1
apache ; apache-2.0 ; name ; apache(?: software)? license(?: version)? v?2(?: 0)?
apache ; apache-2.0 ; name ; apache 2 0(?: license)?
apache2 ; apache-2.0 ; name ; apache2(?: license)?
asl2 ; apache-2.0 ; name ; asl2
expat ; mit ; name ; (?:mit )?expat license
x11 ; x11 ; name ; (?:mit )?x11 license
mit ; mit-0 ; name ; mit no attribution(?: license)?
mit ; mit ; name ; the mit license(?: mit)?
gpl ; gpl-1.0 ; name ; (?:gnu )?gpl(?: version)? v?1(?: 0)?
gpl ; gpl-2.0 ; name ; (?:gnu )?gpl(?: version)? v?2(?: 0)?
gpl ; gpl-2.0-or-later ; name ; (?:gnu )?gpl(?: version)? v?2(?: 0)? or (?:any )?later
gpl ; gpl-2.0-only ; name ; (?:gnu )?gpl(?: version)? v?2(?: 0)? only
gpl ; gpl-3.0 ; name ; (?:gnu )?gpl(?: version)? v?3(?: 0)?
gpl ; gpl-3.0-or-later ; name ; (?:gnu )?gpl(?: version)? v?3(?: 0)? or (?:any )?later
gpl ; gpl-3.0-only ; name ; (?:gnu )?gpl(?: version)? v?3(?: 0)? only
gplv2 ; gpl-2.0 ; name ; (?:gnu )?gplv2
gplv3 ; gpl-3.0 ; name ; (?:gnu )?gplv3
gpl2 ; gpl-2.0 ; name ; gpl2
gpl3 ; gpl-3.0 ; name ; gpl3
general ; gpl-1.0 ; name ; gnu general public license(?: gpl)?(?: version)? v?1(?: 0)?
general ; gpl-2.0 ; name ; gnu general public license(?: gpl)?(?: version)? v?2(?: 0)?
general ; gpl-2.0-or-later ; name ; gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version )?v?2(?: of the license)? or (?:at your option )?any later version
general ; gpl-3.0 ; name ; gnu general public license(?: gpl)?(?: version)? v?3(?: 0)?
general ; gpl-3.0-or-later ; name ; gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version )?v?3(?: of the license)? or (?:at your option )?any later version
lesser ; lgpl-2.1 ; name ; gnu lesser general public license(?: lgpl)?(?: version)? v?2 1
lesser ; lgpl-3.0 ; name ; gnu lesser general public license(?: lgpl)?(?: version)? v?3(?: 0)?
library ; lgpl-2.0 ; name ; gnu library general public license(?: lgpl)?(?: version)? v?2(?: 0)?
affero ; agpl-3.0 ; name ; gnu affero general public license(?: agpl)?(?: version)? v?3(?: 0)?
affero ; agpl-1.0 ; name ; affero general public license(?: version)? v?1(?: 0)?
lgpl ; lgpl-2.0 ; name ; (?:gnu )?lgpl(?: version)? v?2(?: 0)?
lgpl ; lgpl-2.1 ; name ; (?:gnu )?lgpl(?: version)? v?2 1
lgpl ; lgpl-3.0 ; name ; (?:gnu )?lgpl(?: version)? v?3(?: 0)?
lgplv2 ; lgpl-2.1 ; name ; (?:gnu )?lgplv2(?: 1)?
lgplv3 ; lgpl-3.0 ; name ; (?:gnu )?lgplv3
agpl ; agpl-3.0 ; name ; (?:gnu )?agpl(?: version)? v?3(?: 0)?
agplv3 ; agpl-3.0 ; name ; (?:gnu )?agplv3
gfdl ; gfdl-1.2 ; name ; (?:gnu )?gfdl(?: version)? v?1 2
gfdl ; gfdl-1.3 ; name ; (?:gnu )?gfdl(?: version)? v?1 3
documentation ; gfdl-1.2 ; name ; gnu free documentation license(?: version)? v?1 2
documentation ; gfdl-1.3 ; name ; gnu free documentation license(?: version)? v?1 3
bsd ; bsd-2-clause ; name ; (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd bsd)(?: license)?
bsd ; bsd-3-clause ; name ; (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd ; bsd-4-clause ; name ; (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: license)?
0bsd ; 0bsd ; name ; (?:bsd )?0bsd(?: license)?
freebsd ; bsd-2-clause ; name ; freebsd license
mozilla ; mpl-1.0 ; name ; mozilla public license(?: version)? v?1 0
mozilla ; mpl-1.1 ; name ; mozilla public license(?: version)? v?1 1
mozilla ; mpl-2.0 ; name ; mozilla public license(?: version)? v?2 0
mpl ; mpl-1.1 ; name ; mpl(?: version)? v?1 1
mpl ; mpl-2.0 ; name ; mpl(?: version)? v?2(?: 0)?
eclipse ; epl-1.0 ; name ; eclipse public license(?: version)? v?1 0
eclipse ; epl-2.0 ; name ; eclipse public license(?: version)? v?2 0
eclipse ; edl-1.0 ; name ; eclipse distribution license(?: version)?(?: v?1 0)?
epl ; epl-1.0 ; name ; epl(?: version)? v?1 0
epl ; epl-2.0 ; name ; epl(?: version)? v?2 0
cddl ; cddl-1.0 ; name ; cddl(?: version)? v?1 0
cddl ; cddl-1.1 ; name ; cddl(?: version)? v?1 1
distribution ; cddl-1.0 ; name ; common development and distribution license(?: version)? v?1 0
distribution ; cddl-1.1 ; name ; common development and distribution license(?: version)? v?1 1
common ; cpl-1.0 ; name ; common public license(?: version)?(?: v?1 0)?
ibm ; ipl-1.0 ; name ; ibm public license(?: version)?(?: v?1 0)?
cc0 ; cc0-1.0 ; name ; (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc ; cc-by-1.0 ; name ; cc by 1 0
cc ; cc-by-2.0 ; name ; cc by 2 0
cc ; cc-by-2.5 ; name ; cc by 2 5
cc ; cc-by-3.0 ; name ; cc by 3 0
cc ; cc-by-4.0 ; name ; cc by 4 0
cc ; cc-by-sa-2.0 ; name ; cc by sa 2 0
cc ; cc-by-sa-2.5 ; name ; cc by sa 2 5
cc ; cc-by-sa-3.0 ; name ; cc by sa 3 0
cc ; cc-by-sa-4.0 ; name ; cc by sa 4 0
cc ; cc-by-nc-2.0 ; name ; cc by nc 2 0
cc ; cc-by-nc-3.0 ; name ; cc by nc 3 0
cc ; cc-by-nc-4.0 ; name ; cc by nc 4 0
cc ; cc-by-nd-3.0 ; name ; cc by nd 3 0
cc ; cc-by-nd-4.0 ; name ; cc by nd 4 0
cc ; cc-by-nc-sa-3.0 ; name ; cc by nc sa 3 0
cc ; cc-by-nc-sa-4.0 ; name ; cc by nc sa 4 0
cc ; cc-by-nc-nd-3.0 ; name ; cc by nc nd 3 0
cc ; cc-by-nc-nd-4.0 ; name ; cc by nc nd 4 0
attribution ; cc-by-4.0 ; name ; creative commons attribution 4 0
attribution ; cc-by-3.0 ; name ; creative commons attribution 3 0
sharealike ; cc-by-sa-4.0 ; name ; creative commons attribution sharealike 4 0
sharealike ; cc-by-sa-3.0 ; name ; creative commons attribution sharealike 3 0
noncommercial ; cc-by-nc-4.0 ; name ; creative commons attribution noncommercial 4 0
noderivatives ; cc-by-nd-4.0 ; name ; creative commons attribution noderivatives 4 0
noncommercial ; cc-by-nc-sa-4.0 ; name ; creative commons attribution noncommercial sharealike 4 0
noncommercial ; cc-by-nc-nd-4.0 ; name ; creative commons attribution noncommercial noderivatives 4 0
creativecommons ; cc-by ; name ; creativecommons org licenses by \d \d
creativecommons ; cc-by-sa ; name ; creativecommons org licenses by sa \d \d
creativecommons ; cc-by-nc ; name ; creativecommons org licenses by nc \d \d
creativecommons ; cc-by-nd ; name ; creativecommons org licenses by nd \d \d
creativecommons ; cc-by-nc-sa ; name ; creativecommons org licenses by nc sa \d \d
creativecommons ; cc-by-nc-nd ; name ; creativecommons org licenses by nc nd \d \d
creativecommons ; cc0-1.0 ; name ; creativecommons org publicdomain zero 1 0
opensource ; mit ; name ; opensource org licenses mit
opensource ; bsd ; name ; opensource org licenses bsd(?: \d clause)?
opensource ; apache-2.0 ; name ; opensource org licenses apache 2 0
apache ; apache-2.0 ; name ; apache org licenses license 2 0
gnu ; gpl ; name ; gnu org licenses gpl(?: \d \d)?
gnu ; lgpl ; name ; gnu org licenses lgpl(?: \d \d)?
gnu ; agpl ; name ; gnu org licenses agpl(?: \d \d)?
artistic ; artistic-1.0 ; name ; artistic license(?: version)? v?1(?: 0)?
artistic ; artistic-2.0 ; name ; artistic license(?: version)? v?2(?: 0)?
zlib ; zlib ; name ; zlib(?: libpng)? license
libpng ; libpng ; name ; libpng license(?: version 2)?
unlicense ; unlicense ; name ; (?:the )?unlicense(?: license)?
wtfpl ; wtfpl ; name ; wtfpl(?: version)?(?: v?2)?
beerware ; beerware ; name ; beerware(?: license)?
beer ; beerware ; name ; the beer ware license(?: revision 42)?
boost ; bsl-1.0 ; name ; boost software license(?: version)?(?: v?1 0)?
isc ; isc ; name ; (?:the )?isc license
openssl ; openssl ; name ; openssl license
openldap ; oldap ; name ; openldap public license(?: version)?(?: v?2 8)?
postgresql ; postgresql ; name ; postgresql license
sleepycat ; sleepycat ; name ; sleepycat license
ruby ; ruby ; name ; ruby license
php ; php ; name ; php license(?: version)?(?: v?3 01)?
zope ; zpl ; name ; zope public license(?: version)?(?: v?\d \d)?
ofl ; ofl-1.1 ; name ; (?:sil )?ofl(?: version)?(?: v?1 1)?
sil ; ofl-1.1 ; name ; sil open font license(?: version)?(?: v?1 1)?
european ; eupl ; name ; european union public licen[cs]e
eupl ; eupl-1.2 ; name ; eupl(?: version)? v?1 2
osl ; osl-3.0 ; name ; osl(?: version)? v?3 0
open ; osl ; name ; open software license(?: version)?(?: v?\d \d)?
academic ; afl ; name ; academic free license(?: version)?(?: v?\d \d)?
microsoft ; ms-pl ; name ; microsoft public license(?: ms pl)?
microsoft ; ms-rl ; name ; microsoft reciprocal license(?: ms rl)?
unicode ; unicode ; name ; unicode(?: data files and software)? license
w3c ; w3c ; name ; w3c software(?: notice and)?(?: document)? license
ncsa ; ncsa ; name ; (?:university of illinois )?ncsa open source license
vim ; vim ; name ; vim license
json ; json ; name ; the json license
curl ; curl ; name ; curl license
bzip2 ; bzip2 ; name ; bzip2(?: and libbzip2)? license
odbl ; odbl-1.0 ; name ; odbl(?: version)?(?: v?1 0)?
database ; odbl-1.0 ; name ; open database license(?: odbl)?(?: version)?(?: v?1 0)?
elastic ; elastic-2.0 ; name ; elastic license(?: version)?(?: v?2 0)?
sspl ; sspl-1.0 ; name ; sspl(?: version)?(?: v?1 0)?
server ; sspl-1.0 ; name ; server side public license(?: version)?(?: v?1)?
business ; busl-1.1 ; name ; business source license(?: version)?(?: v?1 1)?
commons ; commons-clause ; name ; commons clause license condition(?: version)?(?: v?1 0)?
polyform ; polyform ; name ; polyform (?:noncommercial|shield|strict|perimeter|small business) license
mulan ; mulanpsl-2.0 ; name ; mulan permissive software license(?: version)?(?: v?2)?
blueoak ; blueoak-1.0.0 ; name ; blueoak(?: model)?(?: license)?(?: 1 0 0)?
openrail ; openrail ; name ; (?:bigscience |creativeml )?openrail(?: m)?(?: license)?
llama ; llama ; name ; llama (?:\d )?community license(?: agreement)?
cecill ; cecill ; name ; cecill(?: free software license)?(?: agreement)?
general ; gpl ; family ; gnu general public license
lesser ; lgpl ; family ; gnu lesser general public license
library ; lgpl ; family ; gnu library general public license
affero ; agpl ; family ; gnu affero general public license
documentation ; gfdl ; family ; gnu free documentation license
apache ; apache ; family ; apache(?: software)? license
mit ; mit ; family ; mit(?: style)? license
bsd ; bsd ; family ; bsd(?: style| like)? license
cc ; cc-by ; family ; cc by
cc ; cc-by-sa ; family ; cc by sa
cc ; cc-by-nc ; family ; cc by nc
cc ; cc-by-nd ; family ; cc by nd
cc ; cc-by-nc-sa ; family ; cc by nc sa
cc ; cc-by-nc-nd ; family ; cc by nc nd
mozilla ; mpl ; family ; mozilla public license
eclipse ; epl ; family ; eclipse public license
distribution ; cddl ; family ; common development and distribution license
artistic ; artistic ; family ; artistic license
psf ; psf ; family ; psf license(?: agreement)?
creative ; creative-commons ; family ; creative commons(?: \S+){0,4} license
creative ; creative-commons ; hint ; creative commons
domain ; public-domain ; family ; (?:released|dedicated|placed) (?:in|into|to) the public domain
domain ; public-domain ; hint ; public domain
reserved ; all-rights-reserved ; family ; all rights reserved
proprietary ; proprietary ; family ; proprietary and confidential
proprietary ; proprietary ; hint ; proprietary (?:software|license)
copyright ; copyright-notice ; hint ; copyright(?: c)? (?:19|20)\d\d
""".strip()


@dataclass(frozen=True)
class Rule:
    number: int
    keyword: str
    label: str
    kind: str
    pattern: str

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def weight(self) -> float:
        return KINDS[self.kind][1]


def rules(text: str = RULES) -> list[Rule]:
    parts = [[p.strip() for p in line.split(" ; ")] for line in text.splitlines() if line.strip()]
    return [Rule(i, keyword, label, kind, pattern) for i, (keyword, label, kind, pattern) in enumerate(parts)]
