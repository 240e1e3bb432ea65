import random

import duckdb
import pandas as pd

from fathomline.llm.lines import LINE_SQL, SQL, digest, in_long_runs, remove_repeated_passages, remove_repeated_units, units


def rows(seed=3):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["ab", "Cd", "é", "x|y"]) for _ in range(rng.randrange(1, 12))) for _ in range(25)]
    out = [(k, "\n".join(rng.choice(pool).replace(" ", rng.choice([" ", "  ", "\t"])) for _ in range(rng.randrange(0, 9)))) for k in range(80)]
    return [*out, (200, None), (201, ""), (202, "\n\n"), (203, "a b c d e\n" * 3000), (204, "A  B c d e")]


def test_lines_equal_sql(spark):
    data = rows()
    documents = pd.DataFrame(data, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(LINE_SQL).fetchall())
    got = sorted(tuple(r) for r in digest(remove_repeated_units(spark.createDataFrame(data, "doc_id long, text string"))).collect())
    assert got == want


def test_paragraphs_and_offsets(spark):
    data = [(1, "one two three four five\n\nkeep this line of words"), (2, "other first words of text\n \nOne two  three four five\n\nend of the second text")]
    got = {r.doc_id: r for r in remove_repeated_units(spark.createDataFrame(data, "doc_id long, text string"), unit="paragraph").collect()}
    assert got[1].removed == [] and got[1].kept_text == data[0][1]
    (gone,) = got[2].removed
    assert data[1][1].encode()[gone.start : gone.stop] == b"One two  three four five"
    assert got[2].kept_text == "other first words of text\n \nend of the second text"


def test_repeated_rows_and_null_ids(spark):
    line = "one two three four five"
    got = sorted(((r.doc_id, len(r.removed)) for r in remove_repeated_units(spark.createDataFrame([(3, line), (3, line), (None, line)], "doc_id long, text string")).collect()), key=str)
    assert got == [(3, 0), (3, 0), (None, 1)]


def test_empty_table(spark):
    assert remove_repeated_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_units_cover_the_text():
    assert units(b"a\n\nb", "line") == [(0, 1), (2, 2), (3, 4)]
    assert units(b"", "paragraph") == [(0, 0)]


def passages(seed=5):
    """Texts of sentences, some of them sharing a long passage that begins within a line."""
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(["ab", "Cd", "é", "x|y", f"w{rng.randrange(400)}"]) for _ in range(n)).capitalize() + rng.choice([".", "!", "?!", "。", ".\n"])
    shared = " ".join(sentence(rng.randrange(2, 12)) for _ in range(9))
    short = [sentence(3) for _ in range(6)]
    out = []
    for k in range(90):
        parts = [rng.choice(short) if rng.random() < 0.4 else sentence(rng.randrange(1, 15)) for _ in range(rng.randrange(0, 12))]
        if k % 6 == 0:
            parts.insert(len(parts) // 2, "cut off here " + shared.upper().replace(" ", "  ", 3) + " and on")
        out.append((k, rng.choice([" ", "\n", " \n \n"]).join(parts)))
    return [*out, (200, None), (201, ""), (202, "\n . \n"), (203, "One two three. " * 3000), (204, "no break at all"), (205, "!")]


def test_passages_equal_sql(spark):
    data = passages()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text"]))
    want = sorted(con.execute(SQL).fetchall())
    frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as id", "2 as tag", "'x' as body", "3 as loc", "4 as first", "5 as d1")
    got = sorted(tuple(r) for r in digest(remove_repeated_passages(frame)).collect())
    assert got == want
    by_id = {r[0]: r for r in got}
    assert by_id[0][2] == 0 and all(by_id[k][2] > 0 for k in range(6, 90, 6))


def test_runs_of_words():
    raw = b"a b. c d.\n\n e f. g."
    spans = units(raw, "sentence")
    assert b"".join(raw[a:b] for a, b in spans) == raw
    assert in_long_runs(raw, spans, {0, 1, 2}, 6) == {0, 1, 2}
    assert in_long_runs(raw, spans, {0, 2, 3}, 3) == {2, 3}
    assert in_long_runs(raw, spans, {0, 1}, 5) == set()
    assert units(b"", "sentence") == [] and units(b"..", "sentence") == [(0, 2)]
