import re

from girder.llm import decontaminate as D

ITEM = "A train leaves the old station at 9 and travels 120 km to the coast before Maria boards it with 3 heavy bags"
ITEMS = [(1, ITEM), (2, None), (3, "two words"), (4, "1 2 3 4 5 6 7"), (5, "Which gas do the green plants take in from the air around them when the sun shines")]


def leaks(spark, docs, items=ITEMS):
    rows = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, kind int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_kinds_of_leaks(spark):
    changed = ITEM.replace("120", "250").replace("Maria", "Peter").replace(" 9 ", " 7 ")
    docs = [
        (10, f"Some words before. {ITEM}. Some words after.", 0),
        (11, f"before {changed} after", 0),
        (12, "A train leaves the old station at noon and then nothing else of it", 0),
        (13, None, 0), (14, "", 0), (15, "1 2 3 4 5 6 7 8 9 10 11 12", 0), (16, "two words", 0),
        (17, "word " * 100_000 + ITEM.upper().lower().replace("maria", "Maria"), 0),
        (18, ITEM, 0), (18, ITEM, 0), (None, ITEM, 0),
    ]
    got = leaks(spark, docs)
    assert set(got) == {(10, 1), (11, 1), (17, 1), (18, 1), (None, 1)}
    assert got[10, 1]["kind"] == "exact" and got[10, 1]["changed"] == 0 and got[10, 1]["at"] == 3
    assert got[11, 1]["kind"] == "template" and got[11, 1]["changed"] == 3


def test_copies_in_other_letter_case(spark):
    items = [(1, ITEM), (2, "the tower of Anna Berg stands near the lake of Carl Dahl and Eva Falk in the north")]
    docs = [(k, f"Before it. {change(t)} after it", 0) for k, (change, t) in enumerate([(str.upper, ITEM), (str.lower, ITEM), (str.title, ITEM), (str.upper, items[1][1]), (str.lower, items[1][1])])]
    got = leaks(spark, docs, items)
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)} and all(r["kind"] == "exact" for r in got.values())
    changed = "the tower of Gina Hall stands near the lake of Ivan Jung and Kate Lund in the north"
    assert leaks(spark, [(1, changed, 0)], items)[1, 2]["kind"] == "template"


def test_slots_must_be_consistent(spark):
    items = [(1, "take 5 red apples and 5 green pears then share the 5 bowls with all the guests")]
    text = "take {} red apples and {} green pears then share the {} bowls with all the guests"
    got = leaks(spark, [(1, text.format(8, 8, 8), 0), (2, text.format(8, 9, 8), 0)], items)
    assert set(got) == {(1, 1)} and got[1, 1]["kind"] == "template"


def test_numbers_with_separators_are_one_slot(spark):
    items = [(1, "the bridge is 1,250.5 m long and the river below it is very wide")]
    got = leaks(spark, [(1, "the bridge is 9 m long and the river below it is very wide", 0)], items)
    assert got[1, 1]["changed"] == 1 and got[1, 1]["coverage"] == 1.0


def test_number_words_and_wide_letters(spark):
    items = [(1, "the cook puts 3 kg of flour and then adds water to the bowl before the oven is hot"), (None, "on the hill near the old town Östen Ångström sells red apples and green pears to all who come by")]
    docs = [(1, items[0][1].replace("3", "three"), 0), (2, items[0][1].replace("3", "twenty five"), 0), (3, items[1][1].replace("Östen Ångström", "Émile"), 0), (4, items[1][1], 0), (5, " ".join(items[0][1].split()[:12]), 0)]
    got = leaks(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1), (3, None), (4, None), (5, 1)}
    assert [got[k]["kind"] for k in ((1, 1), (2, 1), (3, None), (4, None), (5, 1))] == ["template", "template", "template", "exact", "partial"]
    assert all(got[k]["coverage"] == 1.0 for k in got if k != (5, 1)) and got[1, 1]["changed"] == 1


def test_windows_that_many_items_and_documents_share(spark):
    """Forty items open with the same words, as do all documents; only the items' own words make candidates."""
    lead = "please read the text below and then choose the answer that fits it best of all"
    tail = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(16))
    items = [(k, f"{lead} {tail(k)}") for k in range(40)]
    docs = [(k, f"{lead} {tail(k)}" if k < 50 else f"{lead} word{k}", 0) for k in range(300)]
    assert set(leaks(spark, docs, items)) == {(k, k) for k in range(40)}


def test_added_and_removed_words(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(38)]
    added = [*words[:12], "really", *words[12:25], "quite", *words[25:]]
    docs = [(1, " ".join(added), 0), (2, " ".join(words[:19] + ["indeed"] + words[19:]), 0), (3, " ".join(words[:12] + words[13:25] + words[26:]), 0), (4, " ".join(words[:12]) + " x" * 60 + " " + " ".join(words[30:]), 0)]
    assert set(leaks(spark, docs, [(1, " ".join(words))])) == {(1, 1), (2, 1), (3, 1)}


def test_slots_of_several_words(spark):
    text = "the shop of {} sold {} loaves and then {} counted what was left of the {} rolls"
    items = [(1, text.format("Anna Maria", "1 200", "Anna Maria", "1 200"))]
    docs = [(1, text.format("Peter", "1200", "Peter", "1200"), 0), (2, text.format("Anna Maria", "1200", "Anna Maria", "1,200"), 0)]
    got = leaks(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1]["kind"] == "template" and got[2, 1]["kind"] == "exact"
    assert got[1, 1]["coverage"] == 1.0


def test_names_that_open_sentences(spark):
    text = "{0} has 5 apples. {0} gives 2 away. {0} buys 4 more. {0} then eats one."
    got = leaks(spark, [(1, text.format("Peter"), 0), (2, text.format("Anna Maria"), 0), (3, text.format("Sara"), 0)], [(1, text.format("Sara"))])
    assert set(got) == {(1, 1), (2, 1), (3, 1)} and got[1, 1]["kind"] == "template" and got[3, 1]["kind"] == "exact"


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, "clean text of some words in a row", "y"), (None, ITEM, "z"), (2, "clean text of some words in a row", "y")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.remove_leaking(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2, 2]
    assert D.find_leaks(docs.limit(0), items).count() == 0
    assert D.remove_leaking(docs, items.limit(0)).count() == 4


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    docs = spark.createDataFrame([(1, ITEM, 0), (1, "clean text of some words", 1), (None, ITEM, 2), (None, "clean text", 3), (None, None, 4), (1, None, 5)], "doc_id long, text string, row int")
    kept = D.remove_leaking(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(r["row"] for r in kept.collect()) == [1, 3, 4, 5]


def test_whole_items_on_driver_data(spark):
    """Without slots in the data, leaks are the documents that hold an item's words in a row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    wanted = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if plain(i["text"]) in plain(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()}
    assert wanted <= got and len(got - wanted) <= 1
