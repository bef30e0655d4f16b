"""Licence scans: normalised sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Sentences of well-known licences, as normalise() leaves them, and the identifier of each.
BODIES: dict[str, str] = {
    "licensed under the apache license, version 2.0 (the license)": "ApacheV2",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0": "ApacheCopy",
    "you may obtain a copy of the license at https://www.apache.org/licenses/license-2.0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "terms and conditions for use, reproduction, and distribution": "ApacheTerms",
    "apache license": "ApacheTitle",
    "version 2.0, january 2004": "ApacheVersion",
    "mit license": "MITTitle",
    "the mit license": "MITTitle",
    "the mit license (mit)": "MITTitle",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MITAsIs",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "MITLiable",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDPermitted",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDBinary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSDAdvertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDAsIs",
    "in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage": "BSDLiable",
    "in no event shall the copyright owner or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage": "BSDLiable",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ZeroBSDGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCAsIs",
    "in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software": "ISCLiable",
    "this software is provided as-is, without any express or implied warranty": "ZlibAsIs",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiable",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "ZlibGrant",
    "the origin of this software must not be misrepresented; you must not claim that you wrote the original software": "ZlibOrigin",
    "if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required": "ZlibAcknowledge",
    "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software": "ZlibAltered",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    "boost software license - version 1.0 - august 17th, 2003": "BSLTitle",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following": "BSLGrant",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "GPLv3Plus",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, version 3 of the license": "GPLv3Only",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version": "GPLv2Plus",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; version 2 of the license": "GPLv2Only",
    "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "GPLHope",
    "see the gnu general public license for more details": "GPLSee",
    "you should have received a copy of the gnu general public license along with this program": "GPLReceived",
    "if not, see https://www.gnu.org/licenses/": "GPLIfNot",
    "if not, see http://www.gnu.org/licenses/": "GPLIfNot",
    "if not, see <https://www.gnu.org/licenses/>": "GPLIfNot",
    "if not, see <http://www.gnu.org/licenses/>": "GPLIfNot",
    "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed": "GNUCopy",
    "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version": "LGPLv21Plus",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "LGPLv3Plus",
    "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "LGPLHope",
    "see the gnu lesser general public license for more details": "LGPLSee",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPLReceived",
    "you should have received a copy of the gnu lesser general public license along with this program": "LGPLReceived",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "AGPLv3Plus",
    "see the gnu affero general public license for more details": "AGPLSee",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLReceived",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "MPLv2",
    "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/": "MPLCopy",
    "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/": "MPLCopy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "EPLv2",
    "to the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0Dedicated",
    "this software is distributed without any warranty": "CC0AsIs",
    "you should have received a copy of the cc0 public domain dedication along with this software": "CC0Received",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "UnlicenseFree",
    "in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain": "UnlicenseDedicate",
    "all rights reserved": "AllRights",
}

#: Licences by their identifier, and the names by which sentences call them.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the mit license", "mit license", "mit"),
    "Apache-2.0": ("the apache license, version 2.0", "the apache license 2.0", "apache license 2.0", "apache 2.0"),
    "BSD-2-Clause": ("the bsd 2-clause license", "the 2-clause bsd license", "the simplified bsd license"),
    "BSD-3-Clause": ("the bsd 3-clause license", "the 3-clause bsd license", "the new bsd license"),
    "ISC": ("the isc license",),
    "Zlib": ("the zlib license",),
    "BSL-1.0": ("the boost software license, version 1.0", "the boost software license 1.0"),
    "GPL-2.0-only": ("the gnu general public license, version 2", "the gnu gpl v2", "the gpl v2", "gplv2"),
    "GPL-2.0-or-later": ("the gnu general public license, version 2 or later", "the gnu gpl, version 2 or later"),
    "GPL-3.0-only": ("the gnu general public license, version 3", "the gnu gpl v3", "the gpl v3", "gplv3"),
    "GPL-3.0-or-later": ("the gnu general public license, version 3 or later", "the gnu gpl, version 3 or later"),
    "LGPL-2.1-only": ("the gnu lesser general public license, version 2.1", "the lgpl v2.1"),
    "LGPL-2.1-or-later": ("the gnu lesser general public license, version 2.1 or later",),
    "LGPL-3.0-only": ("the gnu lesser general public license, version 3", "the lgpl v3"),
    "LGPL-3.0-or-later": ("the gnu lesser general public license, version 3 or later",),
    "AGPL-3.0-only": ("the gnu affero general public license, version 3", "the agpl v3", "agplv3"),
    "AGPL-3.0-or-later": ("the gnu affero general public license, version 3 or later",),
    "MPL-2.0": ("the mozilla public license, version 2.0", "the mozilla public license 2.0", "mpl 2.0"),
    "EPL-2.0": ("the eclipse public license 2.0", "the eclipse public license, version 2.0"),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal", "the cc0 1.0 universal public domain dedication"),
    "Unlicense": ("the unlicense",),
    "CC-BY-4.0": ("cc by 4.0", "cc-by-4.0", "a creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "cc-by-sa-4.0", "a creative commons attribution-sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "cc-by-nc-4.0", "a creative commons attribution-noncommercial 4.0 international license"),
    "CC-BY-ND-4.0": ("cc by-nd 4.0", "cc-by-nd-4.0", "a creative commons attribution-noderivatives 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by-nc-sa 4.0", "cc-by-nc-sa-4.0", "a creative commons attribution-noncommercial-sharealike 4.0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by-nc-nd 4.0", "cc-by-nc-nd-4.0", "a creative commons attribution-noncommercial-noderivatives 4.0 international license"),
}
#: What sentences say of such a name.
SUBJECTS = ("this work is", "this project is", "this software is", "this file is", "this program is", "the code is")
VERBS = ("licensed", "released", "distributed", "available", "published")
#: These ways to say it are one: "licensed under".
SAID = re.compile(f"^(?:(?:{'|'.join(SUBJECTS)}) )?(?:{'|'.join(VERBS)}) under ")


def reference(licence: str) -> str:
    """The identifier of sentences that name a licence."""
    return "Ref" + licence.replace(".", "").replace("-", "")


def known_sentences() -> dict[str, str]:
    """All known sentences: the bodies, those that name a licence, and SPDX lines."""
    named = {f"licensed under {name}": reference(licence) for licence, names in NAMES.items() for name in names}
    return named | {f"spdx-license-identifier: {x.lower()}": reference(x) for x in NAMES} | BODIES


SENTENCES = known_sentences()


@dataclass(frozen=True)
class LicenceRule:
    """A licence and the sequence of sentence identifiers that shows it; others may lie between."""

    licence: str
    sequence: tuple[str, ...]


#: Rules in the order in which they are tried, the longest of a licence first. An
#: identifier that a rule has used is not left for the rules after it.
RULES: tuple[LicenceRule, ...] = (
    LicenceRule("BSD-4-Clause", ("BSDPermitted", "BSDSource", "BSDBinary", "BSDAdvertising", "BSDEndorse", "BSDAsIs", "BSDLiable")),
    LicenceRule("BSD-4-Clause", ("BSDPermitted", "BSDSource", "BSDBinary", "BSDAdvertising")),
    LicenceRule("BSD-3-Clause", ("BSDPermitted", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs", "BSDLiable")),
    LicenceRule("BSD-3-Clause", ("BSDPermitted", "BSDSource", "BSDBinary", "BSDEndorse")),
    LicenceRule("BSD-2-Clause", ("BSDPermitted", "BSDSource", "BSDBinary", "BSDAsIs", "BSDLiable")),
    LicenceRule("BSD-2-Clause", ("BSDPermitted", "BSDSource", "BSDBinary")),
    LicenceRule("BSD-1-Clause", ("BSDPermitted", "BSDSource")),
    LicenceRule("MIT", ("MITTitle", "MITGrant", "MITNotice", "MITAsIs", "MITLiable")),
    LicenceRule("MIT", ("MITGrant", "MITNotice", "MITAsIs", "MITLiable")),
    LicenceRule("MIT", ("MITGrant", "MITNotice", "MITAsIs")),
    LicenceRule("MIT", ("MITGrant", "MITNotice")),
    LicenceRule("MIT-0", ("MITGrant", "MITAsIs")),
    LicenceRule("MIT", ("MITTitle",)),
    LicenceRule("ISC", ("ISCGrant", "ISCAsIs", "ISCLiable")),
    LicenceRule("ISC", ("ISCGrant",)),
    LicenceRule("0BSD", ("ZeroBSDGrant", "ISCAsIs", "ISCLiable")),
    LicenceRule("0BSD", ("ZeroBSDGrant",)),
    LicenceRule("Zlib", ("ZlibAsIs", "ZlibLiable", "ZlibGrant", "ZlibOrigin", "ZlibAcknowledge", "ZlibAltered", "ZlibNotice")),
    LicenceRule("Zlib", ("ZlibGrant", "ZlibOrigin", "ZlibAltered", "ZlibNotice")),
    LicenceRule("BSL-1.0", ("BSLTitle", "BSLGrant")),
    LicenceRule("BSL-1.0", ("BSLGrant",)),
    LicenceRule("BSL-1.0", ("BSLTitle",)),
    LicenceRule("Apache-2.0", ("ApacheV2", "ApacheCompliance", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    LicenceRule("Apache-2.0", ("ApacheV2", "ApacheCompliance")),
    LicenceRule("Apache-2.0", ("ApacheTitle", "ApacheVersion", "ApacheTerms")),
    LicenceRule("Apache-2.0", ("ApacheTitle", "ApacheVersion")),
    LicenceRule("Apache-2.0", ("ApacheV2",)),
    LicenceRule("AGPL-3.0-or-later", ("AGPLv3Plus", "GPLHope", "AGPLSee", "AGPLReceived")),
    LicenceRule("AGPL-3.0-or-later", ("AGPLv3Plus",)),
    LicenceRule("LGPL-2.1-or-later", ("LGPLv21Plus", "LGPLHope", "LGPLSee", "LGPLReceived")),
    LicenceRule("LGPL-2.1-or-later", ("LGPLv21Plus",)),
    LicenceRule("LGPL-3.0-or-later", ("LGPLv3Plus", "GPLHope", "LGPLSee", "LGPLReceived")),
    LicenceRule("LGPL-3.0-or-later", ("LGPLv3Plus",)),
    LicenceRule("GPL-3.0-or-later", ("GPLv3Plus", "GPLHope", "GPLSee", "GPLReceived", "GPLIfNot")),
    LicenceRule("GPL-3.0-or-later", ("GPLv3Plus", "GPLHope")),
    LicenceRule("GPL-3.0-or-later", ("GPLv3Plus",)),
    LicenceRule("GPL-3.0-only", ("GPLv3Only", "GPLHope", "GPLSee", "GPLReceived")),
    LicenceRule("GPL-3.0-only", ("GPLv3Only",)),
    LicenceRule("GPL-2.0-or-later", ("GPLv2Plus", "GPLHope", "GPLSee", "GPLReceived")),
    LicenceRule("GPL-2.0-or-later", ("GPLv2Plus", "GPLHope")),
    LicenceRule("GPL-2.0-or-later", ("GPLv2Plus",)),
    LicenceRule("GPL-2.0-only", ("GPLv2Only", "GPLHope", "GPLSee", "GPLReceived")),
    LicenceRule("GPL-2.0-only", ("GPLv2Only",)),
    LicenceRule("MPL-2.0", ("MPLv2", "MPLCopy")),
    LicenceRule("MPL-2.0", ("MPLv2",)),
    LicenceRule("EPL-2.0", ("EPLv2",)),
    LicenceRule("CC0-1.0", ("CC0Dedicated", "CC0AsIs", "CC0Received")),
    LicenceRule("CC0-1.0", ("CC0Dedicated",)),
    LicenceRule("Unlicense", ("Unlicense", "UnlicenseFree", "UnlicenseDedicate", "MITAsIs", "MITLiable")),
    LicenceRule("Unlicense", ("Unlicense",)),
    *(LicenceRule(x, (reference(x),)) for x in NAMES),
    LicenceRule("LicenseRef-all-rights-reserved", ("AllRights",)),
)

#: Each known sentence holds one of these, which lie within a word, so that no line
#: break or comment mark can part them. Pass others with other sentences.
HINTS = (
    "licen[sc]e", "permission", "redistribution", "reserved", "warrant", "unencumbered", "liable", "advertising", "endorse", "misrepresented",
    "acknowledgment", "removed", "reproduction", "january", "commercial", "jurisdictions", "neighboring", "mpl", "cc0", "released", "distributed", "available", "published",
)

#: A sentence ends at . ! or ? before white space, but not at "v." for version, and at an empty line.
SENTENCE_END = r"(?<=[.!?])(?<![\x20(][vV]\.)[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
_QUOTES = "\"'‘’“”`"


def normalise(sentence: Column) -> Column:
    """Lower case, quotes and comment marks gone, white space single, end mark gone, and with it the
    number of the list item that follows a colon or semicolon."""
    plain = F.translate(F.lower(sentence), _QUOTES, "")
    plain = F.regexp_replace(plain, r"(?m)^[\x20\t]*(?:#+|//+|/?\*+/?|--|;+)", " ")
    plain = F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")
    plain = F.regexp_replace(plain, r"(?<=[:;]) \(?(?:[0-9]{1,2}|[a-z])\)?[. ]*$", "")
    return F.regexp_replace(plain, r"^[ (\[]+|[ .!?:;]+$", "")


def canonical(sentence: Column) -> Column:
    """A normalised sentence that names a licence, in the one way that the table has."""
    return F.regexp_replace(sentence, SAID.pattern, "licensed under ")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: dict[str, str] | None = None,
    rules: tuple[LicenceRule, ...] = RULES,
    hints: tuple[str, ...] = HINTS,
) -> DataFrame:
    """Per row of docs: doc_id, sentence_ids (in order of the text), licences (in order of rules).

    Every sentence of the whole text is normalised and looked up among the known ones, a table of
    fixed size; of a sentence that isn't known, each line is tried as one. The identifiers found, in
    the text's order, are matched against the rules, from first to last: a rule applies if its
    identifiers occur in its order, with any others between; those it used are gone for the rules
    after it. A licence is listed once.

    Null and empty texts have neither. Repeated rows are scanned alike. DataFrame operations only,
    no shuffle; columns besides the two are not read.
    """
    known = {SAID.sub("licensed under ", k): v for k, v in (known or SENTENCES).items()}
    if wrong := [x for x in known if not any(re.search(h, x) for h in hints)]:
        raise ValueError(f"no hint for the sentences {wrong}")
    if wrong := [h for h in hints if re.search(r"\s", h)]:
        raise ValueError(f"hints of more than a word: {wrong}")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    def identify(sentence: Column) -> Column:
        whole = F.try_element_at(table, canonical(normalise(sentence)))
        lines = F.transform(F.split(sentence, "\n"), lambda line: F.try_element_at(table, canonical(normalise(line))))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    # no text without one of these words holds a known sentence; most texts are done here
    hint = F.translate(F.lower("text"), _QUOTES, "").rlike("|".join(hints))
    looked = F.filter(F.flatten(F.transform(sentences(F.col("text")), identify)), lambda x: x.isNotNull())
    found = source.select("doc_id", F.when(hint, looked).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    left = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    state = F.struct(left.alias("left"), F.array().cast("array<string>").alias("licences"))
    plan = F.array(*[F.struct(F.lit(r.licence).alias("licence"), F.lit(_pattern(r)).alias("pattern"), F.lit(_rest(r)).alias("rest")) for r in rules])

    def apply(s: Column, r: Column) -> Column:
        hit = F.regexp_like(s["left"], r["pattern"])
        return F.when(
            hit,
            F.struct(
                F.regexp_replace(s["left"], r["pattern"], r["rest"]).alias("left"),
                F.array_union(s["licences"], F.array(r["licence"])).alias("licences"),
            ),
        ).otherwise(s)

    matched = F.when(F.size("sentence_ids") == 0, state).otherwise(F.aggregate(plan, state, apply))
    return found.select("doc_id", "sentence_ids", matched["licences"].alias("licences"))


def _pattern(rule: LicenceRule) -> str:
    """Matches the identifiers in order; what lies before, between and after is kept in groups."""
    return "^(.*?)" + "(.*?)".join(f"<{x}>" for x in rule.sequence) + "(.*)$"


def _rest(rule: LicenceRule) -> str:
    return "".join(f"${i}" for i in range(1, len(rule.sequence) + 2))
