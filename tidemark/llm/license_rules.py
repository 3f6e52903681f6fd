"""Signature rules of the license scan.

Each line of RULES: label, priority, keyword, regular expression. Priorities: 90 identifiers, 80 full names with a
version, 60 names, 50 grants and conditions, 30 mentions. A keyword is a run of lower-case letters and digits that every
match of its rule holds, so a text without it need not be tried. Expressions ignore ASCII case; a blank stands for any
run of characters other than letters and digits.
"""

from __future__ import annotations

import re
from itertools import product

RULES = r"""
mit | 80 | license | \bthe mit license\b
mit | 80 | license | \bmit licen[cs]ed?\b
mit | 80 | license | \blicen[cs]ed? (?:under|by|with)(?: the)? mit\b
mit | 60 | license | \bexpat licen[cs]e\b
mit | 60 | license | \bx11 licen[cs]e\b
mit | 90 | spdx | \bspdx license identifier mit\b
mit | 50 | permission | \bpermission is hereby granted free of charge to any person obtaining a copy\b
mit | 50 | restriction | \bdeal in the software without restriction\b
mit-0 | 80 | attribution | \bmit no attribution(?: licen[cs]e)?\b
isc | 80 | license | \bisc licen[cs]ed?\b
isc | 50 | permission | \bpermission to use copy modify and or distribute this software for any purpose\b
0bsd | 80 | clause | \bzero clause bsd(?: licen[cs]e)?\b
0bsd | 80 | license | \b0bsd licen[cs]e\b
bsd-2-clause | 80 | clause | \b(?:2|two) clause bsd(?: licen[cs]e)?\b
bsd-2-clause | 80 | license | \bsimplified bsd licen[cs]e\b
bsd-2-clause | 80 | license | \bfreebsd licen[cs]e\b
bsd-3-clause | 80 | clause | \b(?:3|three) clause bsd(?: licen[cs]e)?\b
bsd-3-clause | 80 | license | \b(?:new|revised|modified) bsd licen[cs]e\b
bsd-3-clause | 50 | endorse | \bneither the name of (?:.{1,80}? )?nor the names of its contributors may be used to endorse\b
bsd-4-clause | 80 | clause | \b(?:4|four) clause bsd(?: licen[cs]e)?\b
bsd-4-clause | 50 | advertising | \ball advertising materials mentioning features or use of this software\b
bsd | 60 | license | \bbsd(?: style)? licen[cs]ed?\b
bsd | 50 | redistribut | \bredistribution and use in source and binary forms with or without modification are permitted\b
apache-2 | 90 | spdx | \bspdx license identifier apache 2 0\b
apache-2 | 80 | apache | \bapache licen[cs]e version 2(?: 0)?\b
apache-2 | 80 | apache | \bapache licen[cs]e v?2(?: 0)?\b
apache-2 | 80 | apache | \bapache 2(?: 0)? licen[cs]ed?\b
apache-2 | 80 | asl | \basl 2 0\b
apache-1.1 | 80 | apache | \bapache (?:software )?licen[cs]e (?:version |v)?1 1\b
apache-1.0 | 80 | apache | \bapache (?:software )?licen[cs]e (?:version |v)?1 0\b
apache | 60 | apache | \bapache (?:software )?licen[cs]e\b
gpl | 60 | license | \bgnu general public licen[cs]e\b
gpl | 60 | gpl | \bgnu gpl\b
gpl | 60 | gpl | \blicen[cs]ed under(?: the)? gpl\b
gpl | 30 | copyleft | \bcopyleft\b
lgpl | 60 | license | \bgnu (?:lesser|library) general public licen[cs]e\b
lgpl | 60 | gpl | \bgnu lgpl\b
agpl | 60 | license | \b(?:gnu )?affero general public licen[cs]e\b
agpl | 60 | gpl | \bgnu agpl\b
gfdl | 60 | license | \bgnu free documentation licen[cs]e\b
gpl-exception | 60 | classpath | \bclasspath exception\b
gpl-exception | 60 | gcc | \bgcc runtime library exception\b
gpl | 50 | redistribut | \byou can redistribute it and or modify it under the terms of the gnu\b
gpl | 50 | gnu | \byou should have received a copy of the gnu\b
mpl-2.0 | 80 | mozilla | \bmozilla public licen[cs]e (?:version |v)?2(?: 0)?\b
mpl-1.1 | 80 | mozilla | \bmozilla public licen[cs]e (?:version |v)?1 1\b
mpl-1.0 | 80 | mozilla | \bmozilla public licen[cs]e (?:version |v)?1 0\b
mpl | 60 | mozilla | \bmozilla public licen[cs]e\b
epl-2.0 | 80 | license | \beclipse public licen[cs]e (?:version |v)?2(?: 0)?\b
epl-1.0 | 80 | license | \beclipse public licen[cs]e (?:version |v)?1(?: 0)?\b
epl | 60 | license | \beclipse public licen[cs]e\b
edl | 60 | license | \beclipse distribution licen[cs]e\b
cddl-1.1 | 80 | license | \bcommon development and distribution licen[cs]e (?:version |v)?1 1\b
cddl-1.0 | 80 | license | \bcommon development and distribution licen[cs]e (?:version |v)?1 0\b
cddl | 60 | license | \bcommon development and distribution licen[cs]e\b
cpl | 60 | license | \bcommon public licen[cs]e\b
eupl-1.2 | 80 | license | \beuropean union public licen[cs]e (?:version |v)?1 2\b
eupl-1.1 | 80 | license | \beuropean union public licen[cs]e (?:version |v)?1 1\b
eupl | 60 | license | \beuropean union public licen[cs]e\b
artistic-2.0 | 80 | license | \bartistic licen[cs]e (?:version |v)?2(?: 0)?\b
artistic-1.0 | 80 | license | \bartistic licen[cs]e (?:version |v)?1(?: 0)?\b
artistic | 60 | license | \b(?:perl )?artistic licen[cs]e\b
zlib | 60 | license | \bzlib(?: libpng)? licen[cs]ed?\b
zlib | 50 | warrant | \bthis software is provided as is without any express or implied warranty\b
libpng | 60 | license | \blibpng licen[cs]e\b
bsl-1.0 | 80 | license | \bboost software licen[cs]e(?: version 1 0)?\b
unlicense | 60 | unlicense | \bthe unlicense\b
unlicense | 50 | domain | \bfree and unencumbered software released into the public domain\b
wtfpl | 60 | license | \bdo what the f\w+ you want to public licen[cs]e\b
beerware | 60 | license | \bbeer ?ware licen[cs]e\b
postgresql | 60 | license | \bpostgresql licen[cs]e\b
python-2.0 | 60 | license | \bpython software foundation licen[cs]e\b
php | 60 | license | \bphp licen[cs]e\b
ruby | 60 | license | \bruby licen[cs]e\b
openssl | 60 | license | \bopenssl licen[cs]e\b
curl | 60 | license | \bcurl licen[cs]e\b
vim | 60 | license | \bvim licen[cs]e\b
ncsa | 60 | license | \b(?:university of illinois )?ncsa(?: open source)? licen[cs]e\b
w3c | 60 | license | \bw3c software(?: notice and)? licen[cs]e\b
ofl-1.1 | 80 | license | \bsil open font licen[cs]e(?: version 1 1)?\b
ofl-1.1 | 60 | license | \bopen font licen[cs]e\b
ecl-2.0 | 60 | license | \beducational community licen[cs]e\b
afl-3.0 | 80 | license | \bacademic free licen[cs]e (?:version |v)?3(?: 0)?\b
afl | 60 | license | \bacademic free licen[cs]e\b
osl-3.0 | 80 | license | \bopen software licen[cs]e (?:version |v)?3(?: 0)?\b
osl | 60 | license | \bopen software licen[cs]e\b
ms-pl | 60 | license | \bmicrosoft public licen[cs]e\b
ms-rl | 60 | license | \bmicrosoft reciprocal licen[cs]e\b
apsl-2.0 | 60 | license | \bapple public source licen[cs]e\b
ibm-pl | 60 | license | \bibm public licen[cs]e\b
sleepycat | 60 | license | \bsleepycat licen[cs]e\b
qpl | 60 | license | \bq public licen[cs]e\b
lppl | 60 | license | \blatex project public licen[cs]e\b
zpl | 60 | license | \bzope public licen[cs]e\b
upl-1.0 | 60 | license | \buniversal permissive licen[cs]e\b
mulan-psl-2 | 60 | license | \bmulan permissive software licen[cs]e\b
elastic-2.0 | 60 | license | \belastic licen[cs]e(?: 2 0)?\b
sspl-1.0 | 60 | license | \bserver side public licen[cs]e\b
busl-1.1 | 60 | license | \bbusiness source licen[cs]e\b
odbl-1.0 | 60 | license | \bopen data(?: commons)? (?:open )?database licen[cs]e\b
odc-by | 60 | license | \bopen data commons attribution licen[cs]e\b
pddl | 60 | license | \bpublic domain dedication and licen[cs]e\b
ogl-uk-3.0 | 60 | license | \bopen government licen[cs]e\b
etalab-2.0 | 60 | licen | \blicence ouverte\b
dl-de-by | 60 | datenlizenz | \bdatenlizenz deutschland\b
cdla | 60 | license | \bcommunity data licen[cs]e agreement\b
openrail | 60 | rail | \bopen ?rail(?: m)?(?: licen[cs]e)?\b
llama | 60 | license | \bllama \d(?: \d)? community licen[cs]e\b
afl-2.1 | 80 | license | \bacademic free licen[cs]e (?:version |v)?2 1\b
osl-2.1 | 80 | license | \bopen software licen[cs]e (?:version |v)?2 1\b
osl-1.0 | 80 | license | \bopen software licen[cs]e (?:version |v)?1(?: 0)?\b
aladdin | 60 | license | \baladdin free public licen[cs]e\b
adobe-source | 60 | license | \badobe systems incorporated(?: source code)? licen[cs]e\b
apsl-1.2 | 80 | license | \bapple public source licen[cs]e (?:version |v)?1 2\b
attribution-assurance | 60 | assurance | \battribution assurance licen[cs]e\b
bittorrent | 60 | bittorrent | \bbittorrent open source licen[cs]e\b
blueoak-1.0 | 80 | oak | \bblue oak model licen[cs]e(?: 1 0 0)?\b
bsd-1-clause | 80 | clause | \b(?:1|one) clause bsd(?: licen[cs]e)?\b
bsd-2-clause-patent | 80 | patent | \bbsd (?:2 clause )?plus patent licen[cs]e\b
bsd-3-clause-clear | 80 | clear | \bclear bsd licen[cs]e\b
bsd-3-clause-clear | 50 | patent | \bno express or implied licen[cs]es to any party s patent rights are granted\b
bsd-2-clause | 50 | redistribut | \bredistributions of source code must retain the above copyright notice\b
bsd-2-clause | 50 | redistribut | \bredistributions in binary form must reproduce the above copyright notice\b
bzip2 | 60 | bzip2 | \bbzip2(?: and libbzip2)? licen[cs]e\b
catosl | 60 | license | \bcomputer associates trusted open source licen[cs]e\b
cecill-2.1 | 80 | cecill | \bcecill(?: free software licen[cs]e agreement)? (?:version |v)?2 1\b
cecill-b | 80 | cecill | \bcecill b\b
cecill-c | 80 | cecill | \bcecill c\b
cecill | 60 | cecill | \bcecill\b
clarified-artistic | 80 | clarified | \bclarified artistic licen[cs]e\b
condor | 60 | condor | \bcondor public licen[cs]e\b
cpal-1.0 | 80 | attribution | \bcommon public attribution licen[cs]e(?: (?:version |v)?1 0)?\b
cpol | 60 | project | \bcode project open licen[cs]e\b
cua-opl | 60 | cua | \bcua office public licen[cs]e\b
d-fsl | 60 | freie | \bdeutsche freie software lizenz\b
ecos | 60 | ecos | \becos (?:public )?licen[cs]e\b
efl-2.0 | 60 | eiffel | \beiffel forum licen[cs]e(?: (?:version |v)?2)?\b
entessa | 60 | entessa | \bentessa public licen[cs]e\b
eudatagrid | 60 | datagrid | \beu datagrid software licen[cs]e\b
fair | 60 | license | \bfair licen[cs]e\b
frameworx | 60 | frameworx | \bframeworx(?: open)? licen[cs]e\b
freetype | 60 | freetype | \bfreetype(?: project)? licen[cs]e\b
gpl-exception | 60 | autoconf | \bautoconf (?:configure script )?exception\b
gpl-exception | 60 | bison | \bbison exception\b
gpl-exception | 60 | linking | \blinking exception\b
gpl-exception | 60 | openssl | \bopenssl exception\b
hpnd | 60 | historical | \bhistorical permission notice and disclaimer\b
icu | 60 | icu | \bicu licen[cs]e\b
imagemagick | 60 | imagemagick | \bimagemagick licen[cs]e\b
intel | 60 | intel | \bintel open source licen[cs]e\b
ipa | 60 | license | \bipa font licen[cs]e\b
jasper-2.0 | 60 | jasper | \bjasper(?: software)? licen[cs]e\b
json | 60 | license | \bjson licen[cs]e\b
json | 50 | evil | \bthe software shall be used for good not evil\b
lal-1.3 | 60 | licen | \bfree art licen[cs]e\b
libtiff | 60 | libtiff | \blibtiff licen[cs]e\b
lpl-1.02 | 60 | lucent | \blucent public licen[cs]e(?: (?:version |v)?1 02)?\b
mirros | 60 | miros | \bmiros licen[cs]e\b
motosoto | 60 | motosoto | \bmotosoto open source licen[cs]e\b
mpich2 | 60 | mpich | \bmpich2? licen[cs]e\b
ms-lpl | 60 | microsoft | \bmicrosoft limited public licen[cs]e\b
multics | 60 | multics | \bmultics licen[cs]e\b
nasa-1.3 | 60 | nasa | \bnasa open source agreement(?: (?:version |v)?1 3)?\b
naumen | 60 | naumen | \bnaumen public licen[cs]e\b
netcdf | 60 | netcdf | \bnetcdf licen[cs]e\b
ngpl | 60 | nethack | \bnethack general public licen[cs]e\b
nokia | 60 | nokia | \bnokia open source licen[cs]e\b
nosl | 60 | netizen | \bnetizen open source licen[cs]e\b
npl-1.1 | 60 | netscape | \bnetscape public licen[cs]e(?: (?:version |v)?1 [01])?\b
nposl-3.0 | 80 | profit | \bnon ?profit open software licen[cs]e(?: 3 0)?\b
ntp | 60 | ntp | \bntp licen[cs]e\b
oclc-2.0 | 60 | oclc | \boclc research public licen[cs]e\b
ogc-1.0 | 60 | ogc | \bogc software licen[cs]e\b
oldap-2.8 | 60 | ldap | \bopen ?ldap public licen[cs]e\b
opl-1.0 | 60 | publication | \bopen publication licen[cs]e\b
osc-1.0 | 60 | oset | \boset public licen[cs]e\b
parity-7.0 | 60 | parity | \bparity public licen[cs]e\b
polyform | 60 | polyform | \bpolyform (?:non ?commercial|small business|perimeter|shield|strict|internal use)\b
polyform | 50 | polyform | \bpolyform project\b
psfrag | 60 | psfrag | \bpsfrag licen[cs]e\b
rpl-1.5 | 60 | reciprocal | \breciprocal public licen[cs]e(?: (?:version |v)?1 5)?\b
rpsl-1.0 | 60 | realnetworks | \brealnetworks public source licen[cs]e\b
rscpl | 60 | ricoh | \bricoh source code public licen[cs]e\b
sgi-b-2.0 | 60 | sgi | \bsgi free software licen[cs]e b\b
simpl-2.0 | 60 | simple | \bsimple public licen[cs]e\b
sissl | 60 | sun | \bsun industry standards source licen[cs]e\b
spl-1.0 | 60 | sun | \bsun public licen[cs]e\b
tcl | 60 | tcl | \btcl tk licen[cs]e\b
unicode | 60 | unicode | \bunicode(?: inc)? licen[cs]e agreement\b
vsl-1.0 | 60 | vovida | \bvovida software licen[cs]e\b
watcom-1.0 | 60 | watcom | \bsybase open watcom public licen[cs]e\b
wxwindows | 60 | wxwindows | \bwxwindows library licen[cs]e\b
xnet | 60 | net | \bx net licen[cs]e\b
commons-clause | 60 | clause | \bcommons clause(?: licen[cs]e)? condition\b
confluent | 60 | confluent | \bconfluent community licen[cs]e\b
gemma | 60 | gemma | \bgemma terms of use\b
cc0-1.0 | 80 | cc0 | \bcc0(?: 1 0)?(?: universal)?\b
cc0-1.0 | 80 | creative | \bcreative commons zero\b
cc-by-nc-nd | 60 | creative | \bcreative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?\b
cc-by-nc-sa | 60 | creative | \bcreative commons attribution non ?commercial share ?alike\b
cc-by-nc | 60 | creative | \bcreative commons attribution non ?commercial\b
cc-by-nd | 60 | creative | \bcreative commons attribution no ?deriv(?:ative)?s(?: works)?\b
cc-by-sa | 60 | creative | \bcreative commons attribution share ?alike\b
cc-by | 50 | creative | \bcreative commons attribution\b
cc | 30 | creative | \bcreative commons\b
public-domain | 60 | domain | \b(?:released|dedicated|placed|committed) (?:in|to|into) the public domain\b
public-domain | 30 | domain | \bpublic domain\b
proprietary | 60 | reserved | \ball rights reserved\b
proprietary | 60 | permission | \bmay not be (?:reproduced|copied|distributed) .{0,80}?without (?:the )?(?:prior )?(?:written )?permission\b
proprietary | 50 | license | \bproprietary(?: software)? licen[cs]e\b
proprietary | 50 | license | \bend user licen[cs]e agreement\b
non-commercial | 50 | licen | \blicen[cs]ed? for (?:personal|private|academic) (?:and|or)? ?non ?commercial use\b
no-warranty | 30 | warrant | \bwithout warranty of any kind\b
no-warranty | 30 | warrant | \bas is without warrant(?:y|ies)\b
no-warranty | 30 | warrant | \bwarranties of merchantability\b
copyright-notice | 30 | copyright | \bcopyright (?:c )?(?:\d{4})
unknown-license | 30 | licen | \b(?:released|distributed|published|available|licen[cs]ed) under(?: the)?(?: terms of)?(?: the)? (?:.{1,60}? )?licen[cs]e\b
unknown-license | 30 | spdx | \bspdx license identifier\b
"""


def _families() -> list[tuple[str, int, str, str]]:
    """Rules of numbered families: Creative Commons by element and version, GNU by kind, version and later ones."""
    out = []
    for elements, version in product(("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")):
        label = f"cc-{elements.replace(' ', '-')}"
        out.append((f"{label}-{version.replace(' ', '.')}", 80, "cc", rf"\bcc {elements} {version}\b"))
    for elements in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        out.append((f"cc-{elements.replace(' ', '-')}", 50 + len(elements), "cc", rf"\bcc {elements}\b"))
    for (short, name), version in product((("gpl", "general public"), ("lgpl", "(?:lesser|library) general public"), ("agpl", "affero general public"), ("gfdl", "free documentation")), ("1", "2", "2 1", "3")):
        label = f"{short}-{version.replace(' ', '.')}"
        out.append((f"{label}-or-later", 85, "licen", rf"\b(?:gnu )?{name} licen[cs]e (?:version |v){version}(?: 0)? or (?:any )?later\b"))
        out.append((label, 80, "licen", rf"\b(?:gnu )?{name} licen[cs]e (?:version |v)?{version}(?: 0)?\b"))
        out.append((label, 90, "spdx", rf"\bspdx license identifier {short} {version}(?: 0)?(?: only)?\b"))
        out.append((f"{label}-or-later", 92, "spdx", rf"\bspdx license identifier {short} {version}(?: 0)? or later\b"))
        out.append((label, 70, "gpl" if short != "gfdl" else "gfdl", rf"\b{short} ?v?{version}(?: 0)?\b"))
    return out


def written() -> list[tuple[str, int, str, str]]:
    """The rules of RULES as they stand."""
    lines = [tuple(x.strip() for x in line.split(" | ", 3)) for line in RULES.strip().splitlines()]
    # British spelling as well
    return [(label, int(priority), keyword.replace("license", "licen"), text) for label, priority, keyword, text in lines]


def signatures() -> list[tuple[str, int, str, str, str]]:
    """(label, priority, keyword, expression for any text, expression for a collapsed text) of every rule, in order.

    A collapsed text is in lower case, with one blank for each run of other characters than letters and digits.
    """
    whole = lambda text: "(?is)" + text.replace(" ?", "[^a-z0-9]*").replace(" ", "[^a-z0-9]+")
    return [(label, priority, keyword, whole(text), text) for label, priority, keyword, text in written() + _families()]


def root(keyword: str, single: str) -> str:
    """A word for a first filter over all texts: the one that most rules need, or else the rule's keyword."""
    while (bare := re.sub(r"\([^()]*\)\??", "", single)) != single:
        single = bare  # groups may be optional
    return "licen" if "licen" in single else keyword
