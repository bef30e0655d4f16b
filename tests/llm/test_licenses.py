import re

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import licenses

GRANT = next(k for k, v in licenses.SENTENCES.items() if v == "MITGrant")
NOTICE = next(k for k, v in licenses.SENTENCES.items() if v == "MITNotice")


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.license_scan(df).collect()}


def test_sentences_and_rules(spark):
    wrapped = "Permission is hereby granted" + GRANT[len("permission is hereby granted") :].replace(" copies", "\n# copies") + ".\n\n" + NOTICE.capitalize() + "."
    got = scan(spark, [
        "Some prose. Licensed under the Apache License, Version 2.0.\nMore prose.",
        "no end before\nReleased under the MIT License.\nafter",
        wrapped,
        "Licensed under CC BY-NC 4.0. All rights reserved.",
        "licensed under nothing known",
        "Licensed under the Apache License, Version 2.0 (the \"License\"). Text. You may not use this file except in compliance with the License.",
        "Released under the MIT License. Released under the MIT license!",
    ])
    assert got[0] == (["RefApache20"], ["Apache-2.0"]) and got[1] == (["RefMIT"], ["MIT"])
    assert got[2] == (["MITGrant", "MITNotice"], ["MIT"])
    assert got[3] == (["RefCCBYNC40", "AllRights"], ["CC-BY-NC-4.0", "LicenseRef-all-rights-reserved"])
    assert got[4] == ([], []) and got[5] == (["ApacheV2", "ApacheCompliance"], ["Apache-2.0"]) and got[6] == (["RefMIT", "RefMIT"], ["MIT"])


def brute(ids, rules):
    left, out = list(ids), []
    for rule in rules:
        at, used = 0, []
        for x in rule.sequence:
            if x not in left[at:]:
                break
            used.append(left.index(x, at))
            at = used[-1] + 1
        else:
            left = [x for i, x in enumerate(left) if i not in used]
            out += [rule.licence] * (rule.licence not in out)
    return out


def test_rules_match_brute_force(spark):
    import random

    draw, names = random.Random(3), {v: k for k, v in licenses.SENTENCES.items()}
    texts = [". ".join(names[draw.choice(["BSDPermitted", "BSDSource", "BSDBinary", "BSDEndorse", "GPLv3Plus", "GPLHope", "RefMIT", "BSDAsIs", "BSDLiable", "MITGrant", "MITAsIs"])] for _ in range(draw.randint(0, 7))) + "." for _ in range(200)]
    for ids, found in scan(spark, texts).values():
        assert found == brute(ids, licenses.RULES)


def test_every_sentence_is_found(spark):
    texts = [s[0].upper() + s[1:] + "." for s in licenses.SENTENCES]
    got = scan(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [[v] for v in licenses.SENTENCES.values()]


def test_wrapped_and_quoted_sentences_are_found(spark):
    wrapped = [f"# {s[0].upper()}{s[1:]}.".replace(" ", "\n# ") for s in licenses.SENTENCES]
    got = scan(spark, [*wrapped, "All rights\nreserved.", "# Own work. All rights\n# reserved.", "All \"rights\" re'served.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'])
    n = len(wrapped)
    assert [got[i][0] for i in range(n)] == [[v] for v in licenses.SENTENCES.values()]
    assert all(got[i] == (["AllRights"], ["LicenseRef-all-rights-reserved"]) for i in range(n, n + 3)) and got[n + 3][0] == ["MITAsIs"]
    with pytest.raises(ValueError):
        licenses.license_scan(spark.createDataFrame([], "doc_id long, text string"), hints=(*licenses.HINTS, "public domain"))


def test_edges(spark, edges, empty):
    rows = licenses.license_scan(edges.withColumns({"licences": F.lit(1), "sentence_ids": F.lit(2)})).collect()
    assert len(rows) == edges.count() and all(r.licences == [] == r.sentence_ids for r in rows)
    assert licenses.license_scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(edges, known={"a sentence without a hint": "X"})
    assert re.split(licenses.SENTENCE_END, "a v. 2. b") == ["a v. 2.", "b"]


SEPARATORS, QUOTES = " \t\n\x0b\x0c\r", "\"'‘’“”`"


def plain(sentence):
    """normalise() by hand, character by character."""
    out = []
    for line in "".join(c for c in sentence.lower() if c not in QUOTES).split("\n"):
        bare = line.lstrip(" \t")
        mark = 0
        if bare[:1] in ("#", ";"):
            mark = len(bare) - len(bare.lstrip(bare[0]))
        elif bare.startswith("//"):
            mark = len(bare) - len(bare.lstrip("/"))
        elif bare.startswith("--"):
            mark = 2
        elif bare.startswith(("*", "/*")):
            rest = bare[1:] if bare[0] == "/" else bare
            rest = rest.lstrip("*")
            mark = len(bare) - len(rest[1:] if rest.startswith("/") else rest)
        out.append(" " + bare[mark:] if mark else line)
    words = [w for w in re.split(f"[{SEPARATORS}]", "\n".join(out))]
    text = " ".join(w for w in words if w)
    text = (" " if words[0] == "" else "") + text
    head, _, last = text.rstrip(". ").rpartition(" ")
    bare = last[1:] if last.startswith("(") else last
    bare = bare[:-1] if bare.endswith(")") else bare
    if head.endswith((":", ";")) and (re.fullmatch("[0-9]{1,2}", bare) or re.fullmatch("[a-z]", bare)):
        text = head
    return text.lstrip(" ([").rstrip(" .!?:;")


def test_normalising_matches_brute_force(spark):
    import random

    draw = random.Random(11)
    bits = ["Some", "word", "(the", "License)", '"AS', "IS\"", "v.", "x", "1.", "2)", "a", "met:", "done;", ".", "!", "  ", "\n", "\n# ", "\n// ", "\n * ", "\n-- ", "\t", " ", " ", "'s", "/* ", "*/"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses.normalise(F.col("t")).alias("n"))
    wrong = [(r.t, r.n, plain(r.t)) for r in df.collect() if r.n != plain(r.t)]
    assert not wrong, wrong[:5]


def test_any_known_sentence_wrapped_at_random_is_found(spark):
    import random

    draw = random.Random(12)

    def wrap(sentence):
        mark = draw.choice(["", "# ", "// ", " * ", "-- ", "  "])
        out = ""
        for word in sentence.split(" "):
            if draw.random() < 0.2:
                word = draw.choice([f'"{word}"', word.upper(), word.capitalize()])
            out += (draw.choice([" ", " ", " ", "  ", "\n" + mark, "\r\n" + mark]) if out else mark) + word
        return out + draw.choice([".", "", " .", "!"])

    known = dict(licenses.SENTENCES)
    for licence, names in licenses.NAMES.items():
        known |= {f"{draw.choice(['', *(f'{x} ' for x in licenses.SUBJECTS)])}{verb} under {name}": licenses.reference(licence) for name in names for verb in licenses.VERBS}
    picked = list(licenses.BODIES) * 2 + list(known)
    got = scan(spark, ["Own prose here.\n\n" + wrap(s) + "\n\nMore of it." for s in picked])
    wrong = [(s, got[i][0]) for i, s in enumerate(picked) if got[i][0] != [known[s]]]
    assert not wrong, (len(wrong), wrong[:5])


def test_whole_bodies(spark):
    text = {v: k for k, v in reversed(licenses.BODIES.items())}
    body = lambda *ids: ".\n\n".join(text[x][0].upper() + text[x][1:] for x in ids) + "."
    bsd = "Copyright 2020, Someone.\nAll rights reserved.\n\n" + text["BSDPermitted"] + ":\n1. " + text["BSDSource"] + ".\n2. " + text["BSDBinary"] + ".\n3. " + text["BSDEndorse"] + ".\n\n" + body("BSDAsIs", "BSDLiable")
    got = scan(spark, [
        "MIT License\n\nCopyright (c) 2020 Someone\n\n" + body("MITGrant", "MITNotice", "MITAsIs", "MITLiable"),
        bsd, body("ISCGrant", "ISCAsIs", "ISCLiable"), body("ZeroBSDGrant", "ISCAsIs", "ISCLiable"),
        body("ZlibAsIs", "ZlibLiable", "ZlibGrant", "ZlibOrigin", "ZlibAcknowledge", "ZlibAltered", "ZlibNotice"),
        body("GPLv3Plus", "GPLHope", "GPLSee", "GPLReceived"), body("AGPLv3Plus", "GPLHope", "AGPLSee", "AGPLReceived"),
        body("LGPLv21Plus", "LGPLHope", "LGPLSee", "LGPLReceived"), body("MPLv2", "MPLCopy"), body("Unlicense", "UnlicenseFree", "UnlicenseDedicate", "MITAsIs", "MITLiable"),
        body("CC0Dedicated", "CC0AsIs", "CC0Received"), "# SPDX-License-Identifier: GPL-2.0-or-later", "   Apache License\n   Version 2.0, January 2004\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ])
    want = ["MIT", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "GPL-3.0-or-later", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "MPL-2.0", "Unlicense", "CC0-1.0", "GPL-2.0-or-later", "Apache-2.0"]
    assert [[x for x in got[i][1] if "reserved" not in x] for i in range(len(want))] == [[w] for w in want]
    assert got[1][1][-1] == "LicenseRef-all-rights-reserved"
