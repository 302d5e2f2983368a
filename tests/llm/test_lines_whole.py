"""Line dedup against all templates of all lines, kept as tuples of words."""

import os

import pytest
from tests_llm_brute import repeated_lines

from tallystream.llm import lines
from tallystream.session import read_table

TABLE = "/root/testdata/sf0.01"


def left(spark, texts):
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.text for r in lines.without_repeated_lines(table).collect()}


def want(texts):
    gone = repeated_lines(texts)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in texts.items()}


def test_copy_with_a_changed_word_goes(spark):
    passage = [f"w{chr(97 + i)}" for i in range(24)]
    texts = {}
    for d in range(8):
        words = list(passage)
        if d >= 4:
            words[4 + 5 * (d - 4)] = "other"  # one word, in another segment each
        texts[d] = f"head{chr(97 + d)}\n" + " ".join(words)
    texts[8] = " ".join(passage[:10] + ["quite"] * 14)
    got = left(spark, texts)
    assert got == want(texts)
    assert got[0] == texts[0] and got[8] == texts[8]
    assert all(got[d] == f"head{chr(97 + d)}" for d in range(1, 8))


def test_short_lines_go_by_evidence(spark):
    texts = {d: f"own{chr(97 + d)}\nSo on.\nEnd" + ("\nAnd also." if d < 10 else "") + "\n\n" for d in range(21)}
    got = left(spark, texts)
    assert got == want(texts) and got[0] == texts[0]
    # 2 x 20 and 1 x 20 reach the evidence, 2 x 9 does not
    assert all(got[d] == f"own{chr(97 + d)}" + ("\nAnd also." if d < 10 else "") + "\n\n" for d in range(1, 21))


def test_lines_without_blanks_are_compared_by_characters(spark):
    chinese = "本网站所有内容均受版权保护未经书面许可不得转载或用于任何商业用途"
    thai = "สงวนลิขสิทธิ์ตามกฎหมายห้ามทำซ้ำโดยไม่ได้รับอนุญาต"
    changed = chinese[:20] + "照" + chinese[21:]
    texts = {1: f"甲\n{chinese}\n{thai}", 2: f"乙\n{chinese}\n{thai}", 3: f"丙\n{changed}", 4: f"丁\n{chinese[:5]}",
             5: f"戊\n{chinese[:5]}", 6: f"己2024年{chinese}", 7: f"庚2025年{chinese}"}
    got = left(spark, texts)
    assert got == want(texts)
    assert got == {**texts, 2: "乙", 3: "丙"}


def test_rows_of_numbers_stay(spark):
    texts = {25: "1.2 3.4 5.6 7.8 9.0", 26: "1.2 3.4 5.6 7.8 9.0", 27: " ".join(map(str, range(20))), 28: " ".join(map(str, range(20)))}
    for d in range(25):
        short, long = (" ".join(f"{d}.{i}" for i in range(n)) for n in (5, 20))
        mostly = "at noon " + " ".join(f"{d}.{i}" for i in range(10)) + " we measured with the same device again"  # 9 of 19
        log = " ".join(f"{x} {d}{i}" if i < 4 else x for i, x in enumerate("load of the node was low on this side today".split()))
        texts[d] = f"{short}\n{long}\n{d}\n{mostly}\n{log}"
    got = left(spark, texts)
    assert got == want(texts) and got[0] == texts[0]
    assert all(got[d] == texts[d].rsplit("\n", 1)[0] for d in range(1, 25))  # 10 of the log's 14 tokens are constant
    assert got[26] == texts[26] and got[27] == texts[27] and got[28] == ""  # 5 equal numbers, 20 equal numbers


@pytest.mark.skipif(not os.path.isdir(TABLE), reason="test tables are absent")
def test_all_templates_of_a_larger_table(spark):
    docs = read_table(spark, TABLE, "documents").select("doc_id", "text").toPandas().dropna()
    texts = dict(zip(docs.doc_id, docs.text))
    gone = {r.id: set(r.drops) for r in lines.dropped_lines(spark.createDataFrame(docs)).collect()}
    assert gone == repeated_lines(texts) and sum(map(len, gone.values())) > 100
