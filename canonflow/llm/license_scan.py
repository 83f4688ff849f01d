"""License scan by sentence rules, in DataFrame functions alone.

A text is cut into sentences three times: at sentence ends and line breaks, at
sentence ends alone (for licenses that wrap over lines), and at sentence ends,
blank lines and copyright lines, comment prefixes left out (for notices under
a heading).  Sentences are normalised (lower case, runs of other characters
than letters and digits are one space; a holder's name in the clause about
endorsements is `holder`) and looked up in a table of known license sentences;
of those that say what a text is licensed under, the license's name is looked
up.  The sequences of identifiers found are matched against ordered rules, of
which the first that matches decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import let
from .state import unused

# Known license sentences in normal form, by identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    # notices whose sentences hold a mark at which texts are cut, as the parts that this leaves
    "gpl-free-1": "this program is free software",
    "gpl-free-2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-warranty-1": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-warranty-2": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-notice-1": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "apache-line": "licensed under the apache license version 2 0",
    "mit-line": "released under the mit license",
    "mit-line-2": "licensed under the mit license",
    "gpl-line": "this work is licensed under the gnu general public license version 3",
    "gpl-line-2": "licensed under the gnu general public license version 3",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "cc-by-line": "licensed under cc by 4 0",
    "cc0-line": "this work is dedicated to the public domain under cc0 1 0",
    "reserved": "all rights reserved",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "json-evil": "the software shall be used for good not evil",
    "x11-name": "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium",
    "isc-grant-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "0bsd-grant-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
    "bsd-clear": "redistribution and use in source and binary forms with or without modification are permitted subject to the limitations in the disclaimer below provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-holder": "the name of holder may be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib-claim": "the origin of this software must not be misrepresented",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "libpng-altered": "altered versions must be plainly marked as such and must not be misrepresented as being the original source",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "postgres-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "hpnd-grant": "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    "openssl-product": "this product includes software developed by the openssl project for use in the openssl toolkit",
    "ncsa-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "artistic-intent": "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications",
    "mpl-1-1-contents": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "epl-1-0-materials": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl-2-0-materials": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-2-0-materials-2": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    "cddl-contents": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "wtfpl-do": "0 you just do what the fuck you want to",
    "lppl-work": "this work may be distributed and or modified under the conditions of the latex project public license either version 1 3 of this license or at your option any later version",
    "gnu-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
}

# Fixed values: (license, kind, names, titles). A name follows "licensed under the" and the like, with or without "license" after it, as does the
# license's own identifier; a title is a sentence that stands over the license's whole text.
LICENSES = [
    ("MIT", "permissive", "mit | expat", ""),
    ("X11", "permissive", "x11", ""),
    ("ISC", "permissive", "isc", ""),
    ("0BSD", "permissive", "zero clause bsd | bsd zero clause", ""),
    ("BSD-2-Clause", "permissive", "bsd 2 clause | 2 clause bsd | simplified bsd | freebsd", ""),
    ("BSD-3-Clause", "permissive", "bsd 3 clause | 3 clause bsd | new bsd | modified bsd | revised bsd", ""),
    ("BSD-4-Clause", "permissive", "bsd 4 clause | 4 clause bsd | original bsd", ""),
    ("Apache-1.1", "permissive", "apache software license version 1 1", "the apache software license version 1 1"),
    ("Apache-2.0", "permissive", "apache 2 0 | apache license 2 0 | apache license v2 0 | apache license v 2 0 | apache license version 2 0 | apache software license version 2 0 | apache license version 2", "apache license version 2 0 january 2004 http www apache org licenses | apache license version 2 0 january 2004 https www apache org licenses | apache license version 2 0 january 2004"),
    ("Zlib", "permissive", "zlib | zlib libpng", ""),
    ("BSL-1.0", "permissive", "boost software license 1 0 | boost software license version 1 0", "boost software license version 1 0 august 17th 2003"),
    ("Unlicense", "public-domain", "unlicense", ""),
    ("WTFPL", "permissive", "do what the fuck you want to public license", "do what the fuck you want to public license version 2 december 2004"),
    ("CC0-1.0", "public-domain", "cc0 | cc0 1 0 | cc0 1 0 universal | creative commons zero v1 0 universal | creative commons cc0 1 0", "cc0 1 0 universal | creative commons legal code cc0 1 0 universal"),
    ("PDDL-1.0", "public-domain", "open data commons public domain dedication and license", "open data commons public domain dedication and licence pddl"),
    ("ODbL-1.0", "copyleft", "open database license | odbl | open data commons open database license | odbl 1 0", "open data commons open database license odbl"),
    ("ODC-By-1.0", "permissive", "open data commons attribution license", "open data commons attribution license odc by"),
    ("MPL-1.1", "copyleft", "mozilla public license version 1 1 | mozilla public license 1 1", "mozilla public license version 1 1"),
    ("MPL-2.0", "copyleft", "mozilla public license version 2 0 | mozilla public license 2 0 | mozilla public license v2 0", "mozilla public license version 2 0"),
    ("EPL-1.0", "copyleft", "eclipse public license 1 0 | eclipse public license v1 0 | eclipse public license version 1 0", "eclipse public license v 1 0"),
    ("EPL-2.0", "copyleft", "eclipse public license 2 0 | eclipse public license v2 0 | eclipse public license version 2 0", "eclipse public license v 2 0"),
    ("CDDL-1.0", "copyleft", "common development and distribution license version 1 0", "common development and distribution license cddl version 1 0"),
    ("CDDL-1.1", "copyleft", "common development and distribution license version 1 1", "common development and distribution license cddl version 1 1"),
    ("CPL-1.0", "copyleft", "common public license version 1 0 | common public license 1 0", "common public license version 1 0 | common public license v 1 0"),
    ("IPL-1.0", "copyleft", "ibm public license version 1 0", "ibm public license version 1 0"),
    ("EUPL-1.1", "copyleft", "european union public licence 1 1 | eupl version 1 1", "european union public licence v 1 1"),
    ("EUPL-1.2", "copyleft", "european union public licence 1 2 | eupl version 1 2", "european union public licence v 1 2"),
    ("CECILL-2.1", "copyleft", "cecill license version 2 1 | cecill 2 1", "cecill free software license agreement version 2 1 dated 2013 06 21"),
    ("OSL-3.0", "copyleft", "open software license version 3 0 | open software license 3 0", "open software license v 3 0"),
    ("AFL-3.0", "permissive", "academic free license version 3 0 | academic free license 3 0", "academic free license v 3 0 | academic free license afl v 3 0"),
    ("Artistic-1.0", "permissive", "artistic license 1 0", ""),
    ("Artistic-2.0", "permissive", "artistic license 2 0 | artistic license version 2 0", "the artistic license 2 0 | artistic license 2 0"),
    ("PSF-2.0", "permissive", "python software foundation license version 2 | psf license", "python software foundation license version 2"),
    ("PHP-3.01", "permissive", "php license version 3 01", "the php license version 3 01"),
    ("Ruby", "permissive", "ruby", ""),
    ("NCSA", "permissive", "university of illinois ncsa open source license", "university of illinois ncsa open source license"),
    ("PostgreSQL", "permissive", "postgresql", ""),
    ("HPND", "permissive", "historical permission notice and disclaimer", ""),
    ("OpenSSL", "permissive", "openssl", ""),
    ("W3C", "permissive", "w3c software license", "w3c software notice and license | w3c software and document notice and license"),
    ("UPL-1.0", "permissive", "universal permissive license version 1 0 | universal permissive license v 1 0", "the universal permissive license upl version 1 0"),
    ("BlueOak-1.0.0", "permissive", "blue oak model license 1 0 0", "blue oak model license version 1 0 0 | blue oak model license"),
    ("MulanPSL-2.0", "permissive", "mulan psl v2", "mulan permissive software license version 2 mulan psl v2 january 2020 | mulan permissive software license version 2 mulan psl v2"),
    ("MS-PL", "permissive", "microsoft public license | microsoft public license ms pl", "microsoft public license ms pl"),
    ("MS-RL", "copyleft", "microsoft reciprocal license | microsoft reciprocal license ms rl", "microsoft reciprocal license ms rl"),
    ("ZPL-2.1", "permissive", "zope public license version 2 1", "zope public license zpl version 2 1"),
    ("OFL-1.1", "permissive", "sil open font license version 1 1 | sil open font license 1 1 | open font license", "sil open font license version 1 1 26 february 2007"),
    ("LPPL-1.3c", "permissive", "latex project public license", ""),
    ("Vim", "copyleft", "vim", ""),
    ("Beerware", "permissive", "beerware | beer ware", "the beer ware license revision 42"),
    ("JSON", "non-commercial", "json", ""),
    ("SSPL-1.0", "source-available", "server side public license version 1 | server side public license", "server side public license version 1 october 16 2018"),
    ("Elastic-2.0", "source-available", "elastic license 2 0 | elastic license v2", "elastic license 2 0"),
    ("BUSL-1.1", "source-available", "business source license 1 1", "business source license 1 1"),
    ("GFDL-1.1", "copyleft", "gnu free documentation license version 1 1", "gnu free documentation license version 1 1 march 2000"),
    ("GFDL-1.2", "copyleft", "gnu free documentation license version 1 2", "gnu free documentation license version 1 2 november 2002"),
    ("GFDL-1.3", "copyleft", "gnu free documentation license version 1 3 | gnu free documentation license", "gnu free documentation license version 1 3 3 november 2008"),
]
# Fixed values: (short name, family, versions and the dates over their texts) of the GNU licenses.
GNU = [
    ("GPL", "general", [("1.0", "1", "february 1989"), ("2.0", "2", "june 1991"), ("3.0", "3", "29 june 2007")]),
    ("LGPL", "lesser general", [("2.1", "2 1", "february 1999"), ("3.0", "3", "29 june 2007")]),
    ("LGPL", "library general", [("2.0", "2", "june 1991")]),
    ("AGPL", "affero general", [("3.0", "3", "19 november 2007")]),
]
# Parts of the names of Creative Commons licenses (others than CC0), and their versions with what follows the number in titles.
CREATIVE = [("BY", "attribution", "permissive"), ("BY-SA", "attribution sharealike", "copyleft"), ("BY-ND", "attribution noderivatives", "no-derivatives"), ("BY-NC", "attribution noncommercial", "non-commercial"), ("BY-NC-SA", "attribution noncommercial sharealike", "non-commercial"), ("BY-NC-ND", "attribution noncommercial noderivatives", "non-commercial")]
CREATIVE_VERSIONS = [("2.0", "generic"), ("2.5", "generic"), ("3.0", "unported"), ("4.0", "international")]
#: Sentences that name a license; the last group is the name.
NAMED = r"^(?:spdx license identifier|(?:(?:this|the) (?:[a-z0-9]+ ){1,4}(?:is|are) |it is |(?:[a-z0-9]+ ){1,2}is )?(?:also |dual |hereby |free software )?(?:licensed|released|distributed|available|published|made available|redistributable)(?: to you)? (?:under|by)(?: the terms(?: and conditions)? of)?(?: the)?) (.+?)(?: licen[sc]e)?(?: the license)?$"
#: The clause about endorsements, whoever is named in it.
HOLDER = r"^(?:neither )?the names? of .{1,300}? (?:may|must|shall|can) (?:not )?be used to endorse"


def plain(text: str) -> str:
    """A name in normal form."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).strip()


def _gnu() -> tuple[dict[str, str], list[tuple[str, str, str, list[str]]], dict[str, str]]:
    """Sentences, rules and names of the GNU licenses: headers with and without "or any later version", in one sentence or cut at semicolons, and titles."""
    sentences, rules, names = {}, [], {}
    for short, family, versions in GNU:
        key = f"gnu-{family.split()[0]}"
        license_ = f"gnu {family} public license"
        you = f"you can redistribute it and or modify it under the terms of the {license_}"
        sentences[key] = f"{you} as published by the free software foundation"
        for version, v, date in versions:
            one, later = f"{short}-{version}", f"either version {v} of the license or at your option any later version"
            sentences |= {
                f"{key}-{v}-title": f"{license_} version {v} {date}",
                f"{key}-{v}-later": f"{sentences[key]} {later}",
                f"{key}-{v}-only": f"{you} version {v} as published by the free software foundation",
                f"{key}-{v}-only-2": f"{sentences[key]} version {v} of the license",
                f"{key}-{v}-only-3": f"you can redistribute it and or modify it under the terms of version {v} of the {license_} as published by the free software foundation",
                f"gnu-any-{v}": later,
                f"gnu-one-{v}": f"version {v} of the license",
            }
            rules += [
                (f"{key}-{v}-text", f"{one}-only", "copyleft", [f"{key}-{v}-title"]),
                (f"{key}-{v}-later", f"{one}-or-later", "copyleft", [f"{key}-{v}-later"]),
                (f"{key}-{v}-later-2", f"{one}-or-later", "copyleft", [key, f"gnu-any-{v}"]),
                *[(f"{key}-{v}-{x}", f"{one}-only", "copyleft", [f"{key}-{v}-{x}"]) for x in ("only", "only-2", "only-3")],
                (f"{key}-{v}-only-4", f"{one}-only", "copyleft", [key, f"gnu-one-{v}"]),
            ]
            told = [short.lower(), license_] + [f"{license_} {short.lower()}"]
            for x in told:
                for form in (f"v{v}", f"version {v}", v, plain(version), f"v{plain(version)}", f"version {plain(version)}"):
                    names |= {f"{x} {form}": f"{one}-only", f"{x} {form} or later": f"{one}-or-later", f"{x} {form} or any later version": f"{one}-or-later", f"{x} {form} only": f"{one}-only", f"{x} {form} or at your option any later version": f"{one}-or-later"}
                names[f"version {v} of the {x}"] = f"{one}-only"
            names |= {f"{short.lower()}v{v}": f"{one}-only", f"{short.lower()}v{v}+": f"{one}-or-later", f"{plain(one)} or later": f"{one}-or-later", f"{plain(one)} only": f"{one}-only", plain(one): f"{one}-only"}
    return sentences, rules, names


def _named() -> tuple[dict[str, str], list[tuple[str, str, str, list[str]]], dict[str, str], dict[str, str]]:
    """Titles, their rules, the license of each name, and the kind of each license."""
    titles, rules, names, kinds = {}, [], {}, {}
    for key, kind, told, above in LICENSES:
        kinds[key] = kind
        names |= {x: key for x in [plain(key), *filter(None, told.split(" | "))]}
        for k, title in enumerate(filter(None, above.split(" | "))):
            titles[f"title-{key}-{k + 1}"] = title
            rules.append((f"text-{key}-{k + 1}", key, kind, [f"title-{key}-{k + 1}"]))
    for part, long, kind in CREATIVE:
        for version, after in CREATIVE_VERSIONS:
            key, v = f"CC-{part}-{version}", plain(version)
            kinds[key] = kind
            whole = [f"creative commons {long} {v} {after}", f"creative commons {long} {v}", f"{long} {v} {after}"]
            names |= {x: key for x in (plain(key), f"creative commons {plain(part)} {v}", f"a creative commons {long} {v} {after}", *whole)}
            titles |= {f"title-{key}-1": f"{long} {v} {after}", f"title-{key}-2": f"creative commons {long} {v} {after} public license", f"title-{key}-3": f"{long} {v}" if version < "4" else f"creative commons legal code {long} {v} {after}"}
            rules += [(f"text-{key}-{k}", key, kind, [f"title-{key}-{k}"]) for k in (1, 2, 3)]
    return titles, rules, names, kinds


_GNU_SENTENCES, _GNU_RULES, _GNU_NAMES = _gnu()
_TITLES, _TITLE_RULES, NAMES, KINDS = _named()
KINDS |= {r[1]: r[2] for r in _GNU_RULES}
NAMES |= _GNU_NAMES
#: Identifier of each known sentence in normal form.
KNOWN = {v: k for k, v in {**_TITLES, **_GNU_SENTENCES, **SENTENCES}.items()}

# Fixed values: (rule, license, kind, identifiers that must follow each other in this order, others may lie between).
_TEXT_RULES = [
    ("json-text", "JSON", "non-commercial", ["mit-grant", "json-evil"]),
    ("x11-text", "X11", "permissive", ["mit-grant", "x11-name"]),
    ("mit-text", "MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("isc-text", "ISC", "permissive", ["isc-grant"]),
    ("isc-text-2", "ISC", "permissive", ["isc-grant-2"]),
    ("mit-0-text", "MIT-0", "permissive", ["mit-0-grant"]),
    ("0bsd-text", "0BSD", "permissive", ["0bsd-grant"]),
    ("0bsd-text-2", "0BSD", "permissive", ["0bsd-grant-2"]),
    ("ncsa-text", "NCSA", "permissive", ["ncsa-grant"]),
    ("openssl-text", "OpenSSL", "permissive", ["bsd-grant", "openssl-product"]),
    ("bsd-clear-text", "BSD-3-Clause-Clear", "permissive", ["bsd-clear"]),
    ("bsd-4-text", "BSD-4-Clause", "permissive", ["bsd-grant", "bsd-advertise"]),
    ("bsd-3-text-2", "BSD-3-Clause", "permissive", ["bsd-grant", "bsd-holder"]),
    ("bsd-3-text", "BSD-3-Clause", "permissive", ["bsd-grant", "bsd-endorse"]),
    ("bsd-2-text", "BSD-2-Clause", "permissive", ["bsd-grant"]),
    ("zlib-text", "Zlib", "permissive", ["zlib-claim", "zlib-altered"]),
    ("libpng-text", "Libpng", "permissive", ["zlib-claim", "libpng-altered"]),
    ("boost-text", "BSL-1.0", "permissive", ["boost-grant"]),
    ("unlicense-text", "Unlicense", "public-domain", ["unlicense"]),
    ("postgres-text", "PostgreSQL", "permissive", ["postgres-grant"]),
    ("hpnd-text", "HPND", "permissive", ["hpnd-grant"]),
    ("artistic-text", "Artistic-1.0", "permissive", ["artistic-intent"]),
    ("mpl-1-1-header", "MPL-1.1", "copyleft", ["mpl-1-1-contents"]),
    ("epl-1-0-header", "EPL-1.0", "copyleft", ["epl-1-0-materials"]),
    ("epl-2-0-header", "EPL-2.0", "copyleft", ["epl-2-0-materials"]),
    ("epl-2-0-header-2", "EPL-2.0", "copyleft", ["epl-2-0-materials-2"]),
    ("cddl-header", "CDDL-1.0", "copyleft", ["cddl-contents"]),
    ("wtfpl-text", "WTFPL", "permissive", ["wtfpl-do"]),
    ("lppl-header", "LPPL-1.3c", "permissive", ["lppl-work"]),
    ("apache-header", "Apache-2.0", "permissive", ["apache-grant", "apache-comply"]),
    ("gpl-header", "GPL-3.0-or-later", "copyleft", ["gpl-free"]),
    ("gpl-header-2", "GPL-3.0-or-later", "copyleft", ["gpl-free-1", "gpl-free-2"]),
    ("mpl-header-2", "MPL-2.0", "copyleft", ["mpl-notice-1", "mpl-copy"]),
    ("mpl-header-3", "MPL-2.0", "copyleft", ["mpl-notice-1", "mpl-copy-2"]),
    ("mpl-header", "MPL-2.0", "copyleft", ["mpl-notice"]),
    ("gpl-line", "GPL-3.0-only", "copyleft", ["gpl-line"]),
    ("gpl-line-2", "GPL-3.0-only", "copyleft", ["gpl-line-2"]),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "non-commercial", ["cc-by-nc-line"]),
    ("apache-line", "Apache-2.0", "permissive", ["apache-line"]),
    ("mit-line", "MIT", "permissive", ["mit-line"]),
    ("mit-line-2", "MIT", "permissive", ["mit-line-2"]),
    ("cc-by-line", "CC-BY-4.0", "permissive", ["cc-by-line"]),
    ("cc0-line", "CC0-1.0", "permissive", ["cc0-line"]),
]
#: All rules: titles, GNU headers, texts, names, and at last the reservation of rights.
RULES = [
    *_TITLE_RULES,
    *_GNU_RULES,
    *_TEXT_RULES,
    *[(f"named-{x}", x, KINDS[x], [f"name-{x}"]) for x in dict.fromkeys(NAMES.values())],
    ("reserved", "proprietary", "reserved", ["reserved"]),
]

# Every known sentence, and every one that names a license, has one of these, so a text without any has none of them.
ANCHORS = ["licen", "permission", "warranty", "reserved", "redistribution", "cc0", "software", "mozilla", "attribution", "copy", "advertising", "altered", "wtf", "you just do", "released", "distribut", "available", "published"]

# Where sentences end; the third is for texts without comment prefixes.
LINES, WRAPPED, NOTICES = r"[.!?;:]+\s+|\n", r"[.!?;:]+\s+", r"[.!?;:]+\s+|\n\n+|\n?\u0002\n?"


def identified(sentence: Column) -> Column:
    """The identifier of a sentence in normal form, if it is known."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    named = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, f"name-{v}")])
    endorsing = F.regexp_replace(sentence, HOLDER, "the name of holder may be used to endorse")
    return F.coalesce(F.try_element_at(known, sentence), F.try_element_at(known, endorsing), F.try_element_at(named, F.regexp_extract(sentence, NAMED, 1)))


def sequence(text: Column, breaks: str) -> Column:
    """Identifiers of the known sentences of a text, in order; `breaks` is the pattern at which sentences end."""
    normal = F.regexp_replace(F.lower(F.regexp_replace(text, breaks, "\u0001")), "[^a-z0-9\u0001]+", " ")
    return F.filter(F.transform(F.split(normal, "\u0001", -1), lambda s: identified(F.trim(s))), lambda x: x.isNotNull())


def bare(text: Column) -> Column:
    """A text without what stands before the words of its lines (comment signs, `rem`, `dnl`, item numbers); a copyright line, or a mark of a license block, is \\u0002, "v. 2" is "v 2", and an SPDX mark with its identifier is a sentence."""
    steps = [
        ("\r\n?|\u0002", "\n"),
        (r"(?im)^[^\p{L}\p{N}\n]*?(?:(?:rem|dnl)[ \t]+[^\p{L}\p{N}\n]*?)?(?:copyright\b[^\n]*(?:(?:19|20)[0-9]{2}|\(c\)|©|\[yyyy\]|<year>)|\(c\)[ \t]*(?:19|20)[0-9]{2}|©|(?:begin|end) license block)[^\n]*", "\u0002"),
        (r"(?m)^[^\p{L}\p{N}\n\x02]+", ""),
        (r"(?im)^(?:rem|dnl)(?:[ \t]+[^\p{L}\p{N}\n]*|$)", ""),
        (r"(?m)^[0-9]{1,2}\)[^\p{L}\p{N}\n]+", ""),
        (r"(?i)\bv\.\s+([0-9])", "v $1"),
        (r"(?i)spdx-license-identifier:([^\n\x02]*)", "\u0002spdx license identifier $1\u0002"),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def decided(views: Column) -> Column:
    """The first rule (key, name, kind) whose identifiers one of the views has in their order."""
    rules = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(kind).alias("kind"), F.array(*map(F.lit, ids)).alias("ids")) for k, n, kind, ids in RULES])
    met = lambda ids, rule: F.aggregate(ids, F.lit(0), lambda k, x: F.when(F.get(rule["ids"], k) == x, k + 1).otherwise(k)) == F.size(rule["ids"])
    return F.get(F.filter(rules, lambda r: F.exists(views, lambda ids: met(ids, r))), F.lit(0))


def scan_licenses(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """The columns of `documents` and a struct `license`: sentence_ids (array), rule, name, kind; the last three are null where no rule matches.

    A null text counts as empty: no sentences, no license. Of several licenses the first rule's is reported, and the sentences of the cut that finds most.
    Rows are independent and stay as they are; a column `license` is replaced. No exchange.
    """
    text = F.coalesce(documents[text_column].cast("string"), F.lit(""))
    lower, anchored, none = F.lower(text), F.lit(False), F.array().cast("array<string>")
    for x in ANCHORS:
        anchored = anchored | F.contains(lower, F.lit(x))
    s = documents.drop("license")
    some, views = unused(s, "__some"), unused(s, "__views")
    s = s.withColumn(some, anchored)
    cut = F.array(sequence(text, LINES), sequence(text, WRAPPED), sequence(bare(text), NOTICES))
    s = s.withColumn(views, F.when(F.col(some), cut).otherwise(F.array(none, none, none)))
    longest = lambda v: F.aggregate(v, none, lambda best, x: F.when(F.size(x) > F.size(best), x).otherwise(best))
    told = let(longest(F.col(views)), lambda ids: let(F.when(F.size(ids) > 0, decided(F.col(views))), lambda r: F.struct(ids.alias("sentence_ids"), r["key"].alias("rule"), r["name"].alias("name"), r["kind"].alias("kind"))))
    return s.withColumn("license", told).drop(some, views)
