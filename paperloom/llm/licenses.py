"""Licence scan by ordered signature rules, in DataFrame expressions only.

A rule is a regular expression with a label, a priority and two keywords: single words that every match holds, as any gap
may separate words.  There are some two hundred signatures, each written by hand, and the forms in which texts
refer to a licence by name.  A text without the keywords is never matched against the rules; where a keyword occurs, its rules run and every match is an interval of the text.  An interval inside
another one is suppressed if the other's rule has the higher priority, or the same and the interval is longer or the rule
comes first.  What remains labels the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between words: everything ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licences as (label, keyword, how texts name them).  A space stands for any gap between words.
NAMES = [
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? v?1 1"),
    ("apache", "apache", "apache(?: software)?"),
    ("gpl-2.0", "gnu", "gnu general public(?: license)?(?: version)? v?2(?: 0)?"),
    ("gpl-3.0", "gnu", "gnu general public(?: license)?(?: version)? v?3(?: 0)?"),
    ("gpl", "gnu", "gnu(?: general public)?"),
    ("gpl-2.0", "gpl", "gpl v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", "gpl v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public(?: license)?(?: version)? v?2 1"),
    ("lgpl-3.0", "lesser", "gnu lesser general public(?: license)?(?: version)? v?3(?: 0)?"),
    ("lgpl", "lgpl", "lgpl(?: v?[23](?: [01])?)?"),
    ("agpl-3.0", "affero", "gnu affero general public(?: license)?(?: version)? v?3(?: 0)?"),
    ("agpl-3.0", "agpl", "agpl(?: v?3(?: 0)?)?"),
    ("gfdl", "documentation", "gnu free documentation"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)"),
    ("bsd-3-clause", "bsd", "(?:modified bsd|new bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("bsd", "bsd", "bsd"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license)?(?: version)? v?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public(?: license)?(?: version)? v?2(?: 0)?"),
    ("mpl", "mpl", "mpl(?: v?[12] [01])?"),
    ("epl-1.0", "eclipse", "eclipse public(?: license)?(?: version)? v?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public(?: license)?(?: version)? v?2(?: 0)?"),
    ("cddl-1.0", "cddl", "cddl(?: 1 0)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost-1.0", "boost", "boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("artistic-2.0", "artistic", "artistic(?: license)?(?: version)?(?: 2 0)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("eupl-1.2", "european", "european union public(?: licen[cs]e)?(?: v?1 [12])?"),
    ("ofl-1.1", "font", "sil open font(?: license)?(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "database", "open database(?: license)?(?: v?1 0)?"),
    ("python-2.0", "python", "python software foundation"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?"),
    ("cc-by", "commons", "creative commons attribution(?: [1-4] [05])?"),
]

#: How a text refers to a licence NAME, as (form, keyword, priority of such a mention).
FORMS = [
    ("spdx license identifier NAME", "spdx", 9),
    ("licen[cs]ed under(?: the)?(?: terms of)?(?: the)? NAME(?: licen[cs]e)?", "licen", 8),
    ("released under(?: the)?(?: terms of)?(?: the)? NAME(?: licen[cs]e)?", "released", 7),
    ("distributed under(?: the)?(?: terms of)?(?: the)? NAME(?: licen[cs]e)?", "distributed", 7),
    ("published under(?: the)?(?: terms of)?(?: the)? NAME(?: licen[cs]e)?", "published", 7),
    ("available under(?: the)?(?: terms of)?(?: the)? NAME(?: licen[cs]e)?", "available", 7),
    ("under the terms of(?: the)? NAME(?: licen[cs]e)?", "terms", 6),
    ("NAME (?:public )?licen[cs]e(?:d)?", "licen", 5),
    ("licen[cs]e NAME", "licen", 4),
]

#: Signatures that stand alone, written out one by one from the licences' own sentences and addresses, in order, as
#: label | two keywords | priority | words.
SIGNATURES = r"""
mit | hereby granted | 9 | permission is hereby granted free of charge to any person obtaining a copy
mit | notice substantial | 8 | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | permit furnished | 8 | to permit persons to whom the software is furnished to do so
mit-0 | attribution mit | 9 | mit no attribution
x11 | consortium advertising | 9 | the name of the x consortium shall not be used in advertising
mit-advertising | advertising dealings | 8 | shall be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
bsd | redistribution binary | 9 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions retain | 8 | redistributions of source code must retain the above copyright notice
bsd | redistributions reproduce | 8 | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse contributors | 9 | neither the name of [^\n]{1,60}? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | endorse derived | 7 | may not be used to endorse or promote products derived from this software
bsd-4-clause | advertising mentioning | 9 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause-uc | california berkeley | 9 | this product includes software developed by the university of california berkeley and its contributors
bsd | regents california | 7 | the regents of the university of california
bsd-1-clause | clause bsd | 9 | (?:bsd 1 clause|1 clause bsd) license
bsd-2-clause-patent | bsd patent | 9 | bsd 2 clause plus patent
bsd-3-clause-clear | clear bsd | 9 | (?:the )?clear bsd license
freebsd | freebsd the | 8 | the freebsd (?:copyright|license|project)
0bsd | bsd bsd | 9 | (?:zero clause bsd|bsd zero clause|0bsd)
isc | permission distribute | 9 | permission to use copy modify and or distribute this software for any purpose
isc | internet consortium | 8 | internet (?:software|systems) consortium
hpnd | historical permission | 9 | historical permission notice and disclaimer
ntp | representations suitability | 8 | makes no representations about the suitability (?:of )?this software for any purpose
apache-2.0 | apache apache | 9 | www apache org licenses license 2 0
apache-2.0 | compliance except | 9 | you may not use this file except in compliance with the license
apache-2.0 | warranties conditions | 7 | distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | contributor asf | 8 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-1.1 | includes apache | 9 | this product includes software developed by the apache software foundation
apache-1.0 | apache group | 9 | this product includes software developed by the apache group
gpl | foundation gnu | 9 | under the terms of the gnu general public license as published by the free software foundation
gpl-2.0 | foundation gnu | 9 | gnu general public license as published by the free software foundation (?:either )?version 2
gpl-3.0 | foundation gnu | 9 | gnu general public license as published by the free software foundation (?:either )?version 3
gpl-1.0 | foundation gnu | 9 | gnu general public license as published by the free software foundation (?:either )?version 1
gpl | received gnu | 8 | you should have received a copy of the gnu general public license
gpl | gnu licenses | 7 | www gnu org licenses gpl
gpl | gnu copyleft | 7 | www gnu org copyleft gpl
gpl-2.0 | gnu licenses | 8 | www gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu licenses | 8 | www gnu org licenses gpl 3 0
gpl | gnu details | 8 | see the gnu general public license for more details
gpl-classpath-exception | classpath exception | 9 | classpath exception
gpl-linking-exception | statically dynamically | 9 | linking this library statically or dynamically with other modules
gpl-linking-exception | special permission | 8 | as a special exception [^\n]{1,80}? permission to link
gpl-font-exception | embed font | 8 | create a document which uses this font and embed this font
gpl-bison-exception | bison exception | 9 | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gcc-exception | gcc runtime | 9 | gcc runtime library exception
gpl | designed freedom | 5 | preamble the licenses for most software are designed to take away your freedom to share
lgpl | lesser gnu | 9 | under the terms of the gnu lesser general public license
lgpl | library gnu | 9 | under the terms of the gnu library general public license
lgpl | received lesser | 8 | you should have received a copy of the gnu lesser general public license
lgpl-2.0 | library gnu | 8 | gnu library general public license (?:as published by the free software foundation )?(?:either )?version 2
lgpl-2.1 | lesser gnu | 9 | gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
lgpl-3.0 | lesser gnu | 9 | gnu lesser general public license as published by the free software foundation (?:either )?version 3
lgpl | gnu licenses | 7 | www gnu org licenses lgpl
agpl | affero gnu | 9 | under the terms of the gnu affero general public license
agpl-3.0 | affero gnu | 9 | gnu affero general public license as published by the free software foundation (?:either )?version 3
agpl | received affero | 8 | you should have received a copy of the gnu affero general public license
agpl-1.0 | affero affero | 9 | affero general public license (?:version )?1
gfdl | documentation gnu | 9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant cover | 8 | no invariant sections no front cover texts and no back cover texts
gfdl-1.3 | documentation gnu | 9 | gnu free documentation license version 1 3
gfdl-1.2 | documentation gnu | 9 | gnu free documentation license version 1 2
mpl-1.0 | mozilla subject | 9 | the contents of this file are subject to the mozilla public license version 1 0
mpl-1.1 | mozilla subject | 9 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla subject | 9 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla mpl | 8 | www mozilla org mpl 2 0
mpl-2.0 | incompatible secondary | 8 | incompatible with secondary licenses
npl-1.1 | netscape subject | 9 | subject to the netscape public license
epl-1.0 | eclipse accompanying | 9 | accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse available | 9 | made available under the terms of the eclipse public license (?:v )?2 0
epl | eclipse legal | 8 | www eclipse org legal epl
edl-1.0 | eclipse distribution | 9 | eclipse distribution license (?:v )?1 0
cpl-1.0 | common public | 9 | common public license (?:version |v )?1 0
ipl-1.0 | ibm public | 9 | ibm public license (?:version )?1 0
cddl | common development | 9 | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 | common development | 8 | common development and distribution license (?:cddl )?(?:version )?1 0
cddl-1.1 | common development | 8 | common development and distribution license (?:cddl )?(?:version )?1 1
sissl | sun standards | 9 | sun industry standards source license
spl-1.0 | sun public | 9 | sun public license
scsl | sun community | 9 | sun community source license
bcl | binary agreement | 9 | (?:oracle|sun microsystems) binary code license agreement
eupl-1.1 | eupl licensed | 9 | licensed under the eupl version 1 1
eupl-1.2 | eupl licensed | 9 | licensed under the eupl version 1 2
eupl | european union | 7 | european union public licen[cs]e
cecill-2.1 | cecill cecill | 9 | cecill (?:free software )?license (?:agreement )?(?:version )?2 1
cecill-b | cecill cecill | 9 | cecill b
cecill-c | cecill cecill | 9 | cecill c
cecill | cecill circulated | 8 | cecill license as circulated by cea cnrs and inria
artistic-1.0 | perl terms | 9 | under the same terms as perl itself
artistic | artistic clarified | 8 | clarified artistic license
artistic-1.0 | intent conditions | 7 | the intent of this document is to state the conditions under which a package may be copied
zlib | origin misrepresented | 9 | the origin of this software must not be misrepresented
zlib | altered marked | 8 | altered source versions must be plainly marked as such
zlib | granted applications | 8 | permission is granted to anyone to use this software for any purpose including commercial applications
libpng | png reference | 9 | png reference library license
boost-1.0 | boost software | 9 | distributed under the boost software license version 1 0
boost-1.0 | boost license | 8 | www boost org license 1 0
boost-1.0 | executable processor | 8 | machine executable object code generated by a source language processor
wtfpl | fuck want | 9 | do what the fuck you want to public license
wtfpl | fuck want | 8 | you just do what the fuck you want to
unlicense | unencumbered domain | 9 | this is free and unencumbered software released into the public domain
unlicense | unlicense org | 8 | unlicense org
cc0-1.0 | creativecommons zero | 9 | creativecommons org publicdomain zero 1 0
cc0-1.0 | waived related | 8 | has waived all copyright and related or neighbou?ring rights
cc0-1.0 | cc0 dedication | 8 | cc0 1 0 universal public domain dedication
cc-pdm-1.0 | creativecommons mark | 9 | creativecommons org publicdomain mark 1 0
cc-by | creativecommons licenses | 8 | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons licenses | 8 | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons licenses | 8 | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons licenses | 8 | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons licenses | 8 | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons licenses | 8 | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa | commons attribution | 9 | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | commons attribution | 9 | creative commons attribution non ?commercial no ?deriv(?:s|atives)
cc-by | unrestricted medium | 7 | which permits unrestricted use distribution and reproduction in any medium provided the original (?:work|author)
cc-by-nc | permits commercial | 7 | which permits (?:unrestricted )?non ?commercial use distribution and reproduction in any medium
cc-by-sa | commons attribution | 7 | text is available under the creative commons attribution share ?alike license
cc-sampling | commons sampling | 8 | creative commons sampling (?:plus )?1 0
odbl-1.0 | opendatacommons odbl | 9 | opendatacommons org licenses odbl
odc-by-1.0 | opendatacommons licenses | 9 | opendatacommons org licenses by
pddl-1.0 | opendatacommons pddl | 9 | opendatacommons org licenses pddl
pddl-1.0 | domain dedication | 8 | (?:open data commons )?public domain dedication and licen[cs]e
odc-by-1.0 | commons attribution | 8 | open data commons attribution license
dbcl-1.0 | database contents | 8 | database contents license
cdla-permissive | community data | 9 | community data license agreement permissive
cdla-sharing | community data | 9 | community data license agreement sharing
ogl-uk-3.0 | government open | 9 | open government licen[cs]e v?3 0
ogl-uk | government open | 8 | contains public sector information licensed under the open government licen[cs]e
crown-copyright | crown copyright | 8 | crown copyright
etalab-2.0 | licence ouverte | 9 | licence ouverte (?:etalab|2 0)
dl-de-by-2.0 | datenlizenz namensnennung | 9 | datenlizenz deutschland namensnennung(?: version)? 2 0
ofl-1.1 | font licensed | 9 | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | reserved font | 8 | with reserved font name
ofl-1.1 | sil ofl | 8 | scripts sil org ofl
ufl-1.0 | ubuntu font | 9 | ubuntu font licen[cs]e
bitstream-vera | bitstream vera | 9 | bitstream vera fonts copyright
arphic | arphic public | 9 | arphic public license
gust-font | gust font | 9 | gust font license
lppl-1.3c | latex project | 9 | latex project public license (?:either )?(?:version )?1 3c?
lppl | latex project | 8 | latex project public license
python-2.0 | python software | 9 | python software foundation license(?: version)? 2
python-2.0 | psf licensee | 8 | psf is making python available to licensee on an as is basis
cnri-python | cnri agreement | 9 | cnri open source license agreement
beopen-python | beopen python | 9 | beopen python open source license agreement
postgresql | postgresql global | 8 | postgresql global development group
postgresql | released postgresql | 9 | released under the postgresql licen[cs]e
openssl | openssl toolkit | 9 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic eric | 9 | this product includes cryptographic software written by eric young
curl | curl license | 8 | curl license
icu | icu license | 9 | icu license icu 1 8 1 and later
unicode-dfs | unicode data | 9 | unicode inc license agreement data files and software
unicode-tou | unicode terms | 8 | unicode terms of use
w3c | w3c software | 9 | w3c software (?:notice and|and document) (?:license|notice)
ncsa | illinois ncsa | 9 | university of illinois ncsa open source license
osl-3.0 | open software | 9 | open software license (?:osl )?(?:v |version )?3 0
afl-3.0 | academic free | 9 | academic free license (?:afl )?(?:v |version )?3 0
afl-2.1 | academic free | 9 | academic free license (?:afl )?(?:v |version )?2 1
ms-pl | microsoft public | 9 | microsoft public license
ms-rl | microsoft reciprocal | 9 | microsoft reciprocal license
ms-limited | microsoft limited | 8 | microsoft limited public license
apsl-2.0 | apple public | 9 | apple public source license
ruby | ruby license | 8 | ruby license
ruby | ruby terms | 8 | same terms as ruby
php-3.01 | php license | 9 | php license (?:version )?3 01
php-3.0 | php software | 8 | this product includes php software freely available from
zend-2.0 | zend license | 9 | zend (?:engine )?license
vim | vim license | 8 | vim license
vim | vim charityware | 8 | vim is charityware
beerware | beer worth | 9 | if we meet some day and you think this stuff is worth it you can buy me a beer
json | shall evil | 9 | the software shall be used for good not evil
sleepycat | sleepycat sleepycat | 9 | (?:the )?sleepycat (?:license|software)
qpl-1.0 | public license | 9 | q public license
nokia | nokia open | 9 | nokia open source license
rpl-1.5 | reciprocal public | 9 | reciprocal public license
cpal-1.0 | common attribution | 9 | common public attribution license
ecl-2.0 | educational community | 9 | educational community license
efl-2.0 | eiffel forum | 9 | eiffel forum license
fair | instrument retained | 8 | usage of the works is permitted provided that this instrument is retained with the works
naumen | naumen public | 9 | naumen public license
xnet | net license | 8 | x net license
motosoto | motosoto open | 9 | motosoto open source license
lucent-1.02 | lucent public | 9 | lucent public license
mulan-psl-2.0 | mulan mulan | 9 | mulan (?:psl|permissive software license)(?: v2)?
blueoak-1.0.0 | blue oak | 9 | blue oak model license
upl-1.0 | universal permissive | 9 | universal permissive license
ncgl | commercial government | 8 | non commercial government licen[cs]e
elastic-2.0 | elastic license | 9 | elastic license (?:v |version )?2 0
sspl-1.0 | server side | 9 | server side public license
busl-1.1 | business source | 9 | business source license 1 1
commons-clause | commons clause | 9 | commons clause license condition
polyform | polyform license | 9 | polyform (?:noncommercial|shield|perimeter|strict|small business) license
fsl-1.1 | functional source | 9 | functional source license
openrail | rail rail | 9 | (?:creativeml open rail|openrail) (?:m |m license|license)
llama-community | llama community | 9 | llama [1-9] (?:[1-9] )?community license
gutenberg | ebook anyone | 8 | this ebook is for the use of anyone anywhere (?:at no cost|in the united states)
gutenberg | gutenberg license | 8 | project gutenberg (?:tm )?license
public-domain | domain public | 5 | (?:in|into|to) the public domain
public-domain | dedicated domain | 6 | dedicated to the public domain
public-domain | government government | 7 | (?:is a work of|prepared by) (?:the )?(?:united states|u s) government
proprietary | reserved rights | 3 | all rights reserved
proprietary | confidential proprietary | 6 | confidential and proprietary
proprietary | unauthorized this | 6 | unauthorized (?:copying|reproduction|distribution) of this (?:file|software|document|work)
proprietary | reproduced part | 6 | no part of this (?:publication|book|work|document) may be reproduced
proprietary | reproduced permission | 5 | may not be reproduced (?:or distributed )?without (?:the )?(?:prior )?(?:express )?(?:written )?permission
proprietary | commercial personal | 5 | for personal (?:and |or )?non ?commercial use only
evaluation | evaluation purposes | 5 | for evaluation purposes only
eula | software agree | 5 | by (?:installing|downloading|using) (?:the|this) software you agree to
shareware | shareware this | 5 | this (?:program|software) is shareware
freeware | freeware freeware | 5 | (?:is|as) freeware
warranty-disclaimer | warrant kind | 2 | without warrant(?:y|ies) of any kind
warranty-disclaimer | merchantability fitness | 2 | merchantability (?:and |or )?fitness for a particular purpose
warranty-disclaimer | liable event | 2 | in no event shall [^\n]{1,80}? be liable for any
"""


def pattern(words: str) -> str:
    """A rule's words as a regular expression over the original text: A-Z and a-z agree, any gap separates words."""
    spaced = words.replace("(?: ", rf"(?:{GAP}+").replace("| ", rf"|{GAP}+").replace(" ?", f"{GAP}*").replace(" ", f"{GAP}+")
    return f"(?i)(?<![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])(?:{spaced})(?![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])"


def rules() -> list[tuple[str, tuple[str, str], int, str]]:
    """(label, keywords, priority, pattern), in order; a text must hold both keywords for the pattern to be tried."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, words, rank, p = (x.strip() for x in line.split(" | "))
        out.append((label, tuple(words.split()), int(rank), pattern(p)))
    for form, word, rank in FORMS:
        out += [(label, (word, name_word), rank, pattern(form.replace("NAME", f"(?:{name})"))) for label, name_word, name in NAMES]
    return out


#: Words that a keyword stands for, where it is not the word itself.
WORDS_OF = {"licen": ["license", "licence", "licensed", "licenced", "unlicense"], "warrant": ["warranty", "warranties"], "commercial": ["commercial", "noncommercial"], "rail": ["rail", "openrail"], "bsd": ["bsd", "0bsd"]}
TOP = max(r for _, _, r, _ in rules())


def _any_of(words: list[str]) -> str:
    """A regular expression for the words that shares their beginnings, so a text is looked through once for all of them."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [c + written(below) for c, below in sorted(node.items()) if c]
        body = f"(?:{'|'.join(parts)})" if len(parts) > 1 else "".join(parts)
        return f"(?:{body})?" if "" in node and parts else body

    return written(tree)


def _keywords(text: Column) -> Column:
    """The rules' keywords that a text holds, found as whole words in one pass."""
    stems: dict[str, set[str]] = {}
    for k in {w for r in rules() for w in r[1]}:
        for w in WORDS_OF.get(k, [k]):
            stems.setdefault(w, set()).add(k)
    words = sorted(stems)
    look = f"(?i)(?<![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]){_any_of(words)}(?![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])"
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(look), F.lit(0)), lambda w: F.lower(w)))
    of = F.array(*[F.array(*[F.lit(k) for k in sorted(stems[w])]) for w in words])
    at = lambda w: (F.array_position(F.array(*map(F.lit, words)), w) - 1).cast("int")
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.get(of, at(w)))))


def _matches(text: Column, there: Column) -> Column:
    """All matches of all rules whose keywords are ``there`` (a column, as a lambda would compute an expression per rule): array of (start, end, priority, order, label), start and end in characters."""
    # literals, which the optimiser folds to one constant
    every = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in (("o", i), ("l", label), ("a", words[0]), ("b", words[1]), ("p", rank), ("x", p))]) for i, (label, words, rank, p) in enumerate(rules())])
    live = F.filter(every, lambda r: F.array_contains(there, r["a"]) & F.array_contains(there, r["b"]))
    plain = F.translate(text, "\u0001\u0002", "  ")  # both are gaps, so no match changes

    def spans(r: Column) -> Column:
        """One pass of the rule: its matches are put between marks, whose places follow from the lengths of the parts."""
        parts = F.split(F.regexp_replace(plain, r["x"], F.lit("\u0001$0\u0002")), "\u0001")
        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast("array<struct<s int, e int, p int, o int, l string>>").alias("out"))

        def step(acc: Column, z: Column) -> Column:
            size = F.instr(z, "\u0002") - 1
            one = F.struct(acc["at"].alias("s"), (acc["at"] + size).alias("e"), r["p"].alias("p"), r["o"].alias("o"), r["l"].alias("l"))
            return F.struct((acc["at"] + F.length(z) - 1).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(F.slice(parts, 2, F.size(parts)), start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(live, spans))


def _kept(found: Column) -> Column:
    """Matches that no other suppresses.  In order of (start, longest, priority, rule), an interval lies inside an earlier one
    exactly if an earlier end reaches its own; the furthest end is carried for every priority at or above each level.  A
    later interval that starts at the same place and is as long has no higher priority by that order; the reverse case,
    a weaker interval around a stronger one, keeps both."""
    keyed = F.array_sort(F.transform(found, lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("e"), (-m["p"]).alias("p"), m["o"].alias("o"), m["l"].alias("l"))))
    reach = F.array_repeat(F.lit(-1), TOP + 1)
    kind = "array<struct<s int, e int, p int, l string>>"
    start = F.struct(reach.alias("far"), F.array().cast(kind).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        inside = F.get(acc["far"], -m["p"]) >= -m["e"]
        far = F.transform(acc["far"], lambda x, i: F.when(i <= -m["p"], F.greatest(x, -m["e"])).otherwise(x))
        one = F.array(F.struct(m["s"].alias("s"), (-m["e"]).alias("e"), (-m["p"]).alias("p"), m["l"].alias("l")))
        return F.when(inside, acc).otherwise(F.struct(far.alias("far"), F.concat(acc["out"], one).alias("out")))

    return F.aggregate(keyed, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    The base columns count places of the base phrases; ``spans`` holds the rules' surviving matches as (s, e, p, l): start and
    end in characters, priority, label.  ``labels`` joins the labels of both, ``score`` is the highest priority among them
    over the highest there is (base phrases count like the plain name of a licence), 0 without any.  Null text is
    empty.  Null doc_ids and repeated rows are kept; an empty table gives an empty result; other columns are ignored."""
    phrase = {p: pattern(p) for p in PHRASES}
    alone = pattern("|".join(PHRASES).replace("| ", "|"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("_there", _keywords(F.col("text")))
    has = lambda w: F.array_contains("_there", w)
    some = (has("licen") & (has("gnu") | has("apache") | has("mit"))) | (has("cc") & F.regexp_like("text", F.lit(phrase["cc by"])))
    none = F.array().cast("array<struct<s int, e int, p int, l string>>")
    d = d.withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long"))
    d = d.withColumn("n_base", F.when(some, F.regexp_count("text", F.lit(alone))).otherwise(0).cast("long"))
    d = d.withColumn("_found", F.when(F.size("_there") > 0, _matches(F.col("text"), F.col("_there"))))
    d = d.withColumn("spans", F.when(F.size("_found") > 0, _kept(F.col("_found"))).otherwise(none))
    before = lambda x: F.regexp_count(x, F.lit(WORD)).cast("long")
    d = d.withColumn("first_word", F.when(F.col("n_base") > 0, before(F.regexp_extract("text", f"(?s)^(.*?){alone}", 1))))
    d = d.withColumn("last_word", F.when(F.col("n_base") > 0, before(F.regexp_extract("text", f"(?s)^(.*){alone}", 1))))
    base = F.array_sort(F.array_compact(F.array(*[F.when((F.col("n_base") > 0) & F.regexp_like("text", F.lit(phrase[p])), F.lit(label)) for p, label in PHRASES.items()])))
    d = d.withColumn("_base", base).withColumn("_all", F.array_sort(F.array_union("_base", F.transform("spans", lambda m: m["l"]))))
    strongest = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda m: m["p"])), F.lit(0)), F.when(F.col("n_base") > 0, 5).otherwise(0))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join("_all", ",").alias("labels"), (strongest / F.lit(float(TOP))).cast("double").alias("score"), "spans")
