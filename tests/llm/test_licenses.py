import random
import textwrap
from difflib import SequenceMatcher

import pytest

from girder.llm import licenses as L

BY = {}
for _name, _text in L.TEMPLATES:
    BY.setdefault(_name, []).append(_text)
APACHE, MIT = BY["Apache-2.0"][2], BY["MIT"][1]
LEAD = "Copyright (c) 2019 Foo Inc.\n"


def found(text):
    """Licenses confirmed in a text, with their spans."""
    return [(x[2], text[x[0] : x[1]]) for x in L.notices(text) if x[4]]


def test_blocks_are_runs_of_sentences():
    text = f"First line. Second.\n{APACHE}. More text here. {MIT}"
    assert [text[a:b] for a, b in L.blocks(text)] == [APACHE + ".", MIT]
    assert L.blocks("nothing here") == []


NOTICES = {
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": BY["GPL-3.0"][1],
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": BY["BSD-3-Clause"][0], "BSD-2-Clause": BY["BSD-2-Clause"][0], "MIT": BY["MIT"][0], "ISC": BY["ISC"][0], "Apache-2.0": BY["Apache-2.0"][1], "MPL-2.0": BY["MPL-2.0"][1],
    "CC-BY-3.0": "Licensed under CC BY 3.0.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-SA-2.5": "Licensed under CC BY-SA 2.5.", "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}


@pytest.mark.parametrize("name", NOTICES)
def test_notices_after_a_copyright_line(name):
    for text in (NOTICES[name], textwrap.fill(NOTICES[name], 72), "\n".join(" * " + x for x in textwrap.wrap(NOTICES[name], 60))):
        assert [x for x, _ in found(LEAD + text + "\nint main() { return 0; }")] == [name]


@pytest.mark.parametrize("name", ["GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "Apache-2.0", "MPL-2.0", "CC0-1.0"])
def test_whole_texts(spark, name):
    text = (L.files("girder.llm") / "license_texts" / f"{name}.txt").read_text()
    wanted = name if "." in name else f"{name}.0"
    rows = spark.createDataFrame([(1, f"Some words first.\n{text}\nSome words after.")], "doc_id long, text string")
    got = L.scan(rows).filter("confirmed").collect()
    assert {r["license"] for r in got} == {wanted} and max(r["end"] - r["start"] for r in got) > 0.9 * len(text.strip())


def test_bullets_and_other_owners():
    bsd = BY["BSD-3-Clause"][0].replace("Redistributions of source", "* Redistributions of source").replace("the copyright holder nor", "Foo Inc. nor")
    assert [x for x, _ in found(bsd)] == ["BSD-3-Clause"]


def test_several_notices_in_a_block():
    assert found(LEAD + "Licensed under the MIT License.") == [("MIT", "Licensed under the MIT License.")]
    assert [x for x, _ in found(f"{LEAD}Licensed under the MIT License. Or, at your choice: {APACHE}")] == ["MIT", "Apache-2.0"]
    assert found("Licensed under the MIT License. All rights reserved.") == [("MIT", "Licensed under the MIT License.")]
    assert found("All rights reserved.") == [("All-Rights-Reserved", "All rights reserved.")]


def test_decisive_words():
    assert found("Licensed under CC BY-NC 4.0.")[0][0] == "CC-BY-NC-4.0" and found("Licensed under CC BY 5.0.") == []
    assert found("This work is licensed under the GNU General Public License, version 7.") == []
    assert L.decisive(["gpl", "version", "3.0"]) == L.decisive(["gpl", "version", "3"]) == {"3"}


def test_scan(spark):
    changed = MIT.replace("free of charge", "free of any cost")
    rows = [(1, f"Some words.\n{APACHE}\nMore."), (2, MIT), (3, changed), (4, None), (5, ""), (6, "The licence of the driver was lost on a windy day in the hills."), (7, "word " * 60_000 + "\n" + BY["MIT"][2]), (8, APACHE), (8, APACHE), (None, "All rights reserved."), (9, "This work is licensed under the GNU General Public License, version 2."), (10, "word " * 500 + "In a very long line it is licensed under the MIT License and goes on " + "word " * 500)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = L.scan(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert set(by) == {1, 2, 3, 6, 7, 8, None, 9, 10} and sum(r["doc_id"] == 8 for r in got) == 2
    assert [by[k]["license"] for k in (1, 2, 3, 7, None, 9, 10)] == ["Apache-2.0", "MIT", "MIT", "MIT", "All-Rights-Reserved", "GPL-2.0", "MIT"]
    assert all(by[k]["confirmed"] for k in (1, 2, 3, 7, None, 9, 10)) and not by[6]["confirmed"]
    assert by[3]["missing"] == "charge" and by[3]["added"] == "any cost"
    text = dict(rows)[1]
    assert text[by[1]["start"] : by[1]["end"]] == APACHE and by[1]["missing"] == by[1]["added"] == ""
    assert L.scan(docs.limit(0)).count() == 0


def test_every_template_finds_itself():
    for name, text in L.TEMPLATES:
        assert [x for x, _ in found(text)] == [name], (name, text[:80], found(text))


def brute(text):
    """The license of the template with most words in common, of those whose differences from the whole text pass; every template is compared."""
    words, best = L._words(text), (0, None)
    for name, template in L.TEMPLATES:
        wanted = L._words(template)
        same = sum(r.size for r in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks())
        if len(wanted) - same <= L.MISSING * len(wanted) and len(words) - same <= max(L.FEW, L.ADDED * len(wanted)) and L.decisive(wanted) == L.decisive(words):
            best = max(best, (same, name))
    return best[1]


def test_changed_notices_match_brute_force():
    """Of notices with words changed, the compression's ranking finds what a comparison with all templates finds."""
    r = random.Random(2)
    short = [t for _, t in L.TEMPLATES if len(t) < 2500]
    agreed = 0
    for _ in range(250):
        words = r.choice(short).split()
        for _ in range(r.choice((0, 0, 1, 2, len(words) // 12))):
            k = r.randrange(1, len(words) - 1)
            words[k : k + 1] = r.choice(([], ["changed"], [words[k], "really"]))
        text = " ".join(words)
        got, wanted = [x for x, _ in found(text)], brute(text)
        agreed += (got[:1] or [None])[0] == wanted
        assert wanted is None or not got or got[0] == wanted, (text, got, wanted)
    assert agreed >= 240


def test_lines_of_driver_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cues = ("license", "rights reserved", "cc by")
    wanted = {(r["doc_id"], line) for r in docs.collect() for line in r["text"].split("\n") if any(c in line.lower() for c in cues)}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in L.scan(docs).filter("confirmed").collect()}
    assert wanted and wanted == got


def test_tags_and_names():
    wanted = {"SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "Licensed under the Apache License 2.0": "Apache-2.0", "MIT License\n\nfoo bar": "MIT", "Licensed under the GPL v2": "GPL-2.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "This is free and unencumbered software released into the public domain.": "Unlicense"}
    for text, name in wanted.items():
        assert [x for x, _ in found(text)] == [name], text
    assert found("We like the MIT License head.") == [] and found("SPDX-License-Identifier: Nothing-9.0") == []
    for name, text in L.EVERY:
        assert [x for x, _ in found(text)] == [name], (name, text[:80], found(text))


def test_denied_notices():
    assert found("Not licensed under the MIT License.") == [] and found("It isn't released under the MIT License.") == []
    assert [x for x, _ in found("It is not released under the MIT License. Licensed under CC BY 4.0.")] == ["CC-BY-4.0"]
    assert [x for x, _ in found("This is not ours.\nLicensed under the MIT License.")] == ["MIT"]


@pytest.mark.parametrize("line", ["Licensed under the MIT License.", "Copyright (c) 2019 Foo Inc. All rights reserved."])
def test_many_notices(line):
    """Each of 10,000 notices is found, in a time that doesn't grow with their square."""
    text = f"{line}\n" * 10_000
    assert len(found(text)) == 10_000
    assert len(text) > L.KEPT and L._short.cache_info().maxsize * L.KEPT < 1 << 25


def test_votes_follow_claims():
    """Votes after claims are those of a new count."""
    r = random.Random(3)
    wanted = [r.choice("abcd") for _ in range(12)]
    pairs = {}
    for k in range(11):
        pairs.setdefault((wanted[k], wanted[k + 1]), []).append(k)
    for _ in range(50):
        votes = L.Votes(12, pairs, [r.choice("abcdx") for _ in range(60)])
        for _ in range(4):
            k = r.randrange(55)
            votes.claim(k, k + r.randrange(1, 5))
            fresh = L.Votes(12, pairs, list(votes.words))
            assert votes.best() == fresh.best() and {b: n for b, n in votes.count.items() if n} == {b: n for b, n in fresh.count.items() if n}
