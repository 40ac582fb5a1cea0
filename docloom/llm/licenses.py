"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Rules are regular expressions over the words of a text joined by single spaces (so "Version 2.0" is "version 2 0").
Each family has hand-written forms of its name; the forms of use below turn every name into rules of their own, so
that a bare name counts for less than a grant. A text is searched only for the families whose keyword it holds. A
detection that lies inside another of at least its priority is dropped.
"""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, text_bytes

#: Base phrases and their labels: places count wherever the words stand consecutively.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_LABELS = {phrase.encode(): label for phrase, label in BASE}
#: Places may overlap, so a place is looked ahead at.
_BASE = re.compile(rb"(?<![^ ])(?=(" + b"|".join(map(re.escape, _LABELS)) + rb")(?![^ ]))")

#: label | keyword | forms of the name, over lower-cased words joined by spaces. A form without the family's keyword
#: names its own after an @.
FAMILIES = r"""
apache-2.0 | apache | apache (?:software )?licen[cs]e (?:version )?v?2(?: 0)? ;; apache 2(?: 0)?(?: licen[cs]e)?
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version )?v?1 1 ;; apache 1 1
apache | apache | apache (?:software )?licen[cs]e ;; apache public licen[cs]e
mit | mit | mit licen[cs]e ;; the mit x11 licen[cs]e ;; mit expat(?: licen[cs]e)?
x11 | x11 | x11 licen[cs]e ;; x consortium licen[cs]e @ x consortium
bsd-2-clause | bsd | (?:simplified|freebsd) bsd(?: licen[cs]e)? ;; bsd 2 clause(?: licen[cs]e)? ;; 2 clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|revised|modified) bsd(?: licen[cs]e)? ;; bsd 3 clause(?: licen[cs]e)? ;; 3 clause bsd(?: licen[cs]e)?
bsd-4-clause | bsd | (?:original|old) bsd(?: licen[cs]e)? ;; bsd 4 clause(?: licen[cs]e)? ;; 4 clause bsd(?: licen[cs]e)?
0bsd | bsd | zero clause bsd(?: licen[cs]e)? ;; 0bsd(?: licen[cs]e)? ;; bsd 0 clause(?: licen[cs]e)?
bsd | bsd | bsd licen[cs]e ;; bsd style licen[cs]e
gpl-2.0 | gpl | gpl ?v?2(?: 0)?(?: only)? ;; gnu gpl (?:version )?v?2(?: 0)?
gpl-3.0 | gpl | gpl ?v?3(?: 0)?(?: only)? ;; gnu gpl (?:version )?v?3(?: 0)?
gpl-2.0 | general public | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version )?v?2(?: 0)?
gpl-3.0 | general public | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version )?v?3(?: 0)?
gpl | general public | gnu general public licen[cs]e
lgpl-2.1 | lgpl | lgpl ?v?2 1(?: only)? ;; gnu lgpl (?:version )?v?2 1
lgpl-3.0 | lgpl | lgpl ?v?3(?: 0)?(?: only)? ;; gnu lgpl (?:version )?v?3
lgpl-2.1 | general public | (?:gnu )?(?:lesser|library) general public licen[cs]e (?:version )?v?2 1
lgpl-3.0 | general public | (?:gnu )?(?:lesser|library) general public licen[cs]e (?:version )?v?3(?: 0)?
lgpl | general public | (?:gnu )?(?:lesser|library) general public licen[cs]e
agpl-3.0 | agpl | agpl ?v?3(?: 0)?(?: only)? ;; gnu agpl (?:version )?v?3
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e(?: version)?(?: v?3(?: 0)?)?
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e(?: version)?(?: v?1 [123])? ;; gfdl(?: v?1 [123])? @ gfdl
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:version )?v?1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e (?:version )?v?2(?: 0)?
mpl-2.0 | mpl | mpl ?v?2(?: 0)?
epl-1.0 | eclipse | eclipse public licen[cs]e (?:version )?v?1(?: 0)?
epl-2.0 | eclipse | eclipse public licen[cs]e (?:version )?v?2(?: 0)?
edl | eclipse | eclipse distribution licen[cs]e(?: 1 0)?
cddl | common development | common development and distribution licen[cs]e(?: 1 [01])? ;; cddl(?: v?1 [01])? @ cddl
cpl | common public | common public licen[cs]e(?: 1 0)?
cpal | common public | common public attribution licen[cs]e(?: 1 0)?
eupl | european union public | european union public licen[cs]e(?: v?1 [12])? ;; eupl(?: v?1 [12])? @ eupl
artistic | artistic | (?:perl )?artistic licen[cs]e(?: 1 0)? ;; clarified artistic licen[cs]e
artistic-2.0 | artistic | artistic licen[cs]e (?:version )?2(?: 0)?
isc | isc | isc licen[cs]e ;; internet systems consortium licen[cs]e @ systems consortium
zlib | zlib | zlib licen[cs]e ;; zlib libpng licen[cs]e
libpng | libpng | libpng licen[cs]e(?: 2 0)? ;; png reference library licen[cs]e @ png reference
boost | boost | boost software licen[cs]e(?: version)?(?: 1 0)? ;; bsl 1 0 @ bsl
unlicense | unlicense | the unlicense ;; unlicense org
wtfpl | wtfpl | wtfpl ;; do what the fuck you want to public licen[cs]e @ you want to public
python | python | python software foundation licen[cs]e(?: version)?(?: 2)? ;; psf licen[cs]e @ psf ;; python licen[cs]e 2 0
php | php | php licen[cs]e(?: version)?(?: 3 0[01]?)?
ruby | ruby | ruby licen[cs]e ;; ruby s licen[cs]e
openssl | openssl | openssl licen[cs]e ;; dual openssl and ssleay licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
ofl | open font | (?:sil )?open font licen[cs]e(?: version)?(?: 1 [01])?
odbl | open database | open database licen[cs]e(?: v?1 0)? ;; odbl(?: v?1 0)? @ odbl
pddl | public domain dedication | public domain dedication and licen[cs]e ;; pddl(?: v?1 0)? @ pddl
odc-by | open data commons | open data commons attribution licen[cs]e(?: v?1 0)? ;; odc by(?: v?1 0)? @ odc by
cdla | community data | community data licen[cs]e agreement(?: (?:permissive|sharing))?(?: v?[12] 0)?
cc0 | cc0 | cc0(?: 1 0)?(?: universal)? ;; cc0 public domain dedication
cc0 | creative commons | creative commons (?:cc )?(?:zero|0)(?: 1 0)?
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | cc | cc by nd(?: [1-4] [05])?
cc-by-sa | cc | cc by sa(?: [1-4] [05])?
cc-by | cc | cc by [1-4] [05]
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by | creative commons | creative commons attribution(?: [1-4] [05])?(?: international)?
creative-commons | creative commons | creative commons(?: public)? licen[cs]e
public-domain | public domain | (?:placed|released|dedicated) (?:in|in to|into|to) the public domain ;; public domain (?:work|software|text)
proprietary | proprietary | proprietary (?:and confidential|licen[cs]e|software|information) ;; confidential and proprietary
proprietary | prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this \w+)? is (?:strictly )?prohibited
reserved | rights | (?:no|some) rights reserved
reserved | vorbehalten | alle rechte vorbehalten
reserved | droits | tous droits r\S+serv\S+
reserved | derechos | todos los derechos reservados
copyright | copyright | copyright (?:c )?(?:by )?(?:19|20)\d\d(?: (?:19|20)\d\d)? ;; copyright holders?
eula | end user | end user licen[cs]e agreement ;; eula @ eula
shareware | shareware | shareware ;; evaluation copy @ evaluation copy
freeware | freeware | freeware ;; free for non ?commercial use @ free for non
ms-pl | microsoft | microsoft public licen[cs]e ;; ms pl @ ms pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e ;; ms rl @ ms rl
sspl | server side | server side public licen[cs]e(?: v?1)? ;; sspl(?: v?1)? @ sspl
busl | business source | business source licen[cs]e(?: v?1 1)? ;; (?:busl|bsl) v?1 1 @ 1 1
elastic | elastic | elastic licen[cs]e(?: v?2(?: 0)?)?
vim | vim | vim licen[cs]e
w3c | w3c | w3c software (?:notice and )?licen[cs]e
json | json | json licen[cs]e ;; shall be used for good not evil @ for good not evil
beerware | beer | beer ?ware licen[cs]e
unicode | unicode | unicode (?:data files and software )?licen[cs]e
adobe | adobe | adobe (?:systems incorporated )?(?:source code )?licen[cs]e(?: agreement)? ;; adobe glyph list licen[cs]e
aladdin | aladdin | aladdin (?:ghostscript )?free public licen[cs]e
afl | academic free | academic free licen[cs]e(?: v?[123] [0-2])? ;; afl(?: v?[123] [0-2]) @ afl
osl | open software | open software licen[cs]e(?: v?[123] [01])? ;; osl(?: v?[123] [01]) @ osl
apsl | apple | apple public source licen[cs]e(?: v?[12] [0-2])? ;; apsl(?: v?[12] [0-2])? @ apsl
apple-mit | apple | apple mit licen[cs]e
arphic | arphic | arphic public licen[cs]e
bittorrent | bittorrent | bittorrent open source licen[cs]e(?: 1 [01])?
blue-oak | blue oak | blue oak model licen[cs]e(?: 1 0 0)?
bsd-clear | clear bsd | clear bsd licen[cs]e ;; bsd 3 clause clear @ clause clear
bsd-patent | bsd | bsd 2 clause plus patent ;; bsd (?:plus |and )patents?
caldera | caldera | caldera licen[cs]e
catosl | computer associates | computer associates trusted open source licen[cs]e
cecill-b | cecill | cecill b(?: v?1)?
cecill-c | cecill | cecill c(?: v?1)?
cecill | cecill | cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: v?[12](?: [01])?)?
cern-ohl | cern | cern open hardware licen[cs]e(?: v?[12](?: [0-2])?)? ;; cern ohl(?: [psw])?(?: v?[12](?: [0-2])?)?
cua-opl | cua office | cua office public licen[cs]e(?: 1 0)?
curl | curl | curl licen[cs]e
d-fsl | german free software | german free software licen[cs]e ;; deutsche freie software lizenz @ freie software lizenz
ecl | educational community | educational community licen[cs]e(?: v?[12] 0)?
efl | eiffel | eiffel forum licen[cs]e(?: v?[12](?: 0)?)?
entessa | entessa | entessa public licen[cs]e(?: 1 0)?
eudatagrid | eu datagrid | eu datagrid software licen[cs]e
fair | fair licen | fair licen[cs]e
frameworx | frameworx | frameworx open licen[cs]e(?: 1 0)?
ftl | freetype | (?:the )?freetype (?:project )?licen[cs]e
gl2ps | gl2ps | gl2ps licen[cs]e
hpnd | historical permission | historical permission notice and disclaimer
ijg | jpeg | independent jpeg group licen[cs]e
icu | icu | icu licen[cs]e
imagemagick | imagemagick | imagemagick licen[cs]e
intel | intel | intel open source licen[cs]e ;; intel simplified software licen[cs]e
ipl | ibm | ibm public licen[cs]e(?: v?1 0)?
ipa | ipa font | ipa font licen[cs]e
jasper | jasper | jasper licen[cs]e(?: 2 0)?
lal | free art | free art licen[cs]e(?: 1 [23])? ;; licence art libre @ art libre
lppl | latex project | latex project public licen[cs]e(?: v?1 [0-3][abc]?)? ;; lppl(?: v?1 [0-3][abc]?)? @ lppl
liliq | liliq | liliq (?:p|r|rplus)(?: v?1 1)?
lucent | lucent | lucent public licen[cs]e(?: v?1 0[0-2]?)?
miros | miros | miros licen[cs]e
motosoto | motosoto | motosoto open source licen[cs]e
mulan | mulan | mulan permissive software licen[cs]e(?: v?[12])? ;; mulan psl(?: v?[12])?
multics | multics | multics licen[cs]e
nasa | nasa | nasa open source agreement(?: 1 3)?
naumen | naumen | naumen public licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
nethack | nethack | nethack general public licen[cs]e
netcdf | netcdf | netcdf licen[cs]e
netscape | netscape | netscape public licen[cs]e(?: v?1 [01])? ;; npl 1 [01] @ npl
nokia | nokia | nokia open source licen[cs]e
nposl | non profit open | non profit open software licen[cs]e(?: 3 0)?
ntp | ntp | ntp licen[cs]e
oclc | oclc | oclc research public licen[cs]e(?: 2 0)?
oldap | openldap | openldap public licen[cs]e(?: v?2 [0-8])?
opl | open publication | open publication licen[cs]e(?: v?1 0)? ;; open content licen[cs]e @ open content
oset | oset | oset public licen[cs]e(?: 2 1)?
pil | python imaging | python imaging library licen[cs]e
polyform | polyform | polyform (?:non ?commercial|small business|shield|strict|perimeter|free trial|internal use) licen[cs]e(?: 1 0 0)?
commons-clause | commons clause | commons clause(?: licen[cs]e)?(?: condition)?(?: v?1 0)?
prosperity | prosperity | prosperity public licen[cs]e(?: [23] 0 0)?
parity | parity public | parity public licen[cs]e(?: [67] 0 0)?
qpl | q public | q public licen[cs]e(?: 1 0)? ;; qpl(?: v?1 0)? @ qpl
rpl | reciprocal public | reciprocal public licen[cs]e(?: 1 [15])?
rpsl | realnetworks | realnetworks public source licen[cs]e(?: v?1 0)?
rscpl | ricoh | ricoh source code public licen[cs]e
sgi-b | sgi | sgi free software licen[cs]e b(?: v?[12] [01])?
simpl | simple public | simple public licen[cs]e(?: 2 0)?
sissl | sun industry | sun industry standards source licen[cs]e(?: v?1 [12])?
sleepycat | sleepycat | sleepycat licen[cs]e
spl | sun public | sun public licen[cs]e(?: v?1 0)?
tcl | tcl | tcl tk licen[cs]e ;; tcl licen[cs]e
upl | universal permissive | universal permissive licen[cs]e(?: v?1 0)? ;; upl 1 0 @ upl
vsl | vovida | vovida software licen[cs]e(?: v?1 0)?
watcom | watcom | sybase open watcom public licen[cs]e(?: 1 0)?
wxwindows | wxwindows | wxwindows library licen[cs]e
xnet | x net | x net licen[cs]e
xfree86 | xfree86 | xfree86 licen[cs]e(?: 1 1)?
zend | zend | zend (?:engine )?licen[cs]e(?: v?2 0)?
zpl | zope | zope public licen[cs]e(?: v?[12] [01])? ;; zpl(?: v?[12] [01])? @ zpl
hippocratic | hippocratic | hippocratic licen[cs]e(?: v?[123] [01])?
anti-996 | 996 | anti 996 licen[cs]e(?: v?1 0)?
ogl | open government | open government licen[cs]e(?: v?[123] 0)?
etalab | etalab | (?:etalab )?licence ouverte(?: v?[12] 0)? @ licence ouverte ;; etalab 2 0
dl-de | datenlizenz deutschland | datenlizenz deutschland (?:namensnennung|zero)(?: 2 0)?
nlod | norwegian licence | norwegian licence for open government data(?: 2 0)?
gemma | gemma | gemma (?:terms of use|licen[cs]e)
llama | llama | llama [234](?: [123])? community licen[cs]e(?: agreement)?
rail | rail | (?:open)?rail m? ?licen[cs]e ;; responsible ai licen[cs]e @ responsible ai
"""

#: Terms that stand in the texts of licenses rather than in notices: label | keyword | form
CLAUSES = r"""
mit | free of charge | permission is hereby granted free of charge to any person obtaining a copy
mit | without restriction | deal in the software without restriction
isc | permission to use | permission to use copy modify and or distribute this software for any purpose
bsd | redistribution and use | redistribution and use in source and binary forms
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from
apache-2.0 | compliance with the license | you may not use this file except in compliance with the license
gpl | free software | this program is free software you can redistribute it and or modify
gpl | without even the implied | without even the implied warranty of merchantability
lgpl | this library is free | this library is free software you can redistribute it
mpl-2.0 | subject to the terms | this source code form is subject to the terms of the mozilla
boost | machine executable object | machine executable object code generated by a source language processor
zlib | altered source versions | altered source versions must be plainly marked as such
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
warranty | warranty of any kind | provided as is without warranty of any kind
warranty | as is | the software is provided as is
"""

#: Forms of use: pattern around a name, priority, and how sure a detection makes it.
USES = (
    (r"spdx licen[cs]e identifier {}", 5, 0.98),
    (r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed) (?:under|by) (?:the )?(?:terms of the )?{}", 4, 0.95),
    (r"(?:unter|sous|bajo|segun) (?:der|dem|die|la|le|licence|licencia|lizenz)? ?(?:licen[cs]e|licen[cs]ia|lizenz)? ?{}", 3, 0.9),
    (r"(?:under|see|and|or) (?:the )?{}", 2, 0.85),
    (r"{}", 1, 0.7),
)


@functools.lru_cache(1)
def rules() -> list[tuple[bytes, re.Pattern, str, int, float]]:
    """(keyword, regular expression, label, priority, certainty), those of the highest priority first."""
    found = []
    for line in filter(None, map(str.strip, FAMILIES.splitlines())):
        label, family, forms = (x.strip() for x in line.split("|", 2))
        for form in forms.split(";;"):
            name, _, own = (x.strip() for x in form.partition("@"))
            found += [((own or family).encode(), use.format(f"(?:{name})"), label, rank, sure) for use, rank, sure in USES]
    for line in filter(None, map(str.strip, CLAUSES.splitlines())):
        label, key, form = (x.strip() for x in line.split("|", 2))
        found.append((key.encode(), form, label, 6, 0.95))
    return sorted(((k, re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label, rank, sure) for k, p, label, rank, sure in found), key=lambda x: -x[3])


@functools.lru_cache(1)
def _by_keyword() -> dict[bytes, list[tuple[re.Pattern, str, int, float]]]:
    """The rules of each keyword."""
    of: dict[bytes, list[tuple[re.Pattern, str, int, float]]] = {}
    for key, *rule in rules():
        of.setdefault(key, []).append(tuple(rule))
    return of


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def resolve(found: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Of (start, end, label, priority, certainty): those not inside another of at least their priority, by a sweep.

    Of equal spans with equal priority the first label in order stays, so the result has no ties.
    """
    kept: list[tuple[int, int, str, int, float]] = []
    starts: list[int] = []  # of spans none of which holds another, so their ends rise too
    ends: list[int] = []
    for x in sorted(set(found), key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
        at = bisect.bisect_right(starts, x[0])
        if at and ends[at - 1] >= x[1]:
            continue
        kept.append(x)
        # those kept before that lie inside it tell nothing more than it does
        upto = bisect.bisect_right(ends, x[1])
        lo = bisect.bisect_left(starts, x[0])
        starts[lo:upto], ends[lo:upto] = [x[0]], [x[1]]
    return sorted(kept)


def scan_text(data: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text's bytes."""
    low = data.translate(_LOWER)
    if not low:
        return 0, 0, None, None, "", "", 0.0
    is_word = np.frombuffer(low, np.uint8) != 32
    n_words = int(np.count_nonzero(is_word[1:] & ~is_word[:-1])) + int(is_word[0])
    text = low.strip(b" ") if b"  " not in low else b" ".join(low.split())
    starts, base, words, at = [], set(), 0, 0
    for m in _BASE.finditer(text):
        words += text.count(b" ", at, m.start())  # words since the place before
        at = m.start()
        starts.append(words)
        base.add(_LABELS[m[1]])
    found = []
    for key, own in _by_keyword().items():
        if key in text:
            for pattern, label, rank, sure in own:
                found += [(m.start(), m.end(), label, rank, sure) for m in pattern.finditer(text)]
    kept = resolve(found)
    doubt = 1.0
    for x in kept:
        doubt *= 1 - x[4]
    score = max(1 - doubt, 0.5 if base else 0.0)
    labels = sorted(base | {x[2] for x in kept})
    return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), score


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    Null and empty texts have no words, null places, empty labels and score 0. Every row gives one row, repeated
    rows included; other columns aren't read; an empty table gives an empty one. Texts are searched whole.
    """
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return per_row(docs.select(F.col(id_col), text_bytes(text_col).alias("data")), scan_text, schema, id_col)
