import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbaline.functions.rules import chunk_pieces, peel, tokenize
from verbaline.operators import tokens

#: Text and its tokens; _ marks that one space follows.
GOLDEN = [
    ("Hello, world!", "Hello|,_|world|!"), ("$100", "$100"), ("100$", "100|$"), ("100US$", "100|US$"), ("€5.5 (approx.)", "€5.5_|(|approx|.|)"),
    ("U.S.", "U.S."), ("USA.", "USA|."), ("I.", "I."), ("100.", "100|."), ("well-known", "well|-|known"), ("a--b", "a|--|b"), ("a---b", "a|---|b"), ("a–b", "a|–|b"), ("a~b", "a|~|b"),
    ("3+4", "3|+|4"), ("5-6", "5|-|6"), ("5-a", "5|-|a"), ("a-5", "a-5"), ("-5", "-5"), ("x=y", "x|=|y"), ("a:b", "a|:|b"), ("a/b", "a|/|b"), ("12:30", "12:30"), ("1/2", "1/2"),
    ("end.Start", "end|.|Start"), ("a,b", "a|,|b"), ("a...b", "a|...|b"), ("don't", "don't"), ("John's", "John|'s"), ("'s", "'|s"), ("''s", "'|'s"),
    ("http://a.b/c,", "http://a.b/c|,"), ("https://ex.com/p", "https://ex.com|/|p"), ('("Hi!")', '(|"|Hi|!|"|)'), ("wait...", "wait|..."), ("...wait", "...|wait"),
    ("wait……", "wait|……"), ("……wait", "…|…|wait"), ("+5", "+5"), ("+a", "+|a"), ("5+", "5|+"), ("20°C.", "20°C|."), ("_x_", "_|x|_"), ("a_b", "a_b"), ("#tag", "#|tag"), ("C#", "C|#"),
    ("50%", "50%"), ("%50", "%|50"), ("a@b.com", "a@b.com"), ("e.g.", "e.g|."), ("é.", "é."), ("né-fr", "né-fr"), ("a  b", "a_| |b"), (" a", " |a"), ("a ", "a_"), ("a  ", "a_| "),
    ("a\nb", "a|\n|b"), ("a \n b", "a_|\n |b"), ("", ""),
]


@pytest.mark.parametrize(("text", "want"), GOLDEN)
def test_golden(text, want):
    got = "|".join(text[a:b] + "_" * c for a, b, c in tokenize(text, {}))
    assert got == want


def test_currency_option():
    assert chunk_pieces("$100") == ["$100"] and chunk_pieces("$100", currency=True) == ["$", "100"]
    assert peel("ab|.") == ([], "ab|", ["."])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.A'-,:/+$5…\" \n\té€😀()"), max_size=40))
def test_tokens_rebuild_the_text(text):
    spans = tokenize(text, {})
    assert "".join(text[a:b] + " " * c for a, b, c in spans) == text
    assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_tables(spark):
    rows = [(1, "Hello, world!"), (2, ""), (3, None), (4, "né 😀 x"), (1 << 40, "a \n b")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: bytes(r.buffer) if r.buffer is not None else None for r in tokens.packed(df, "id").collect()}
    assert len(got[1]) == 69 and got[1][:4] == (13).to_bytes(4, "little") and got[2] == bytes(8) and got[3] is None
    for i, text in rows:
        if text:
            n = len(text.encode())
            assert got[i][4 : 4 + n].decode() == text
            body = [int.from_bytes(got[i][k : k + 4], "little") for k in range(4 + n, len(got[i]), 4)]
            spans = tokenize(text, {})
            want = [x for a, b, c in spans for x in (len(text[:a].encode()), len(text[:b].encode()), int(c))]
            assert body == [len(spans), *want]
    t = tokens.rule_token_table(df, "id")
    assert t.where("id = 3 or id = 2").count() == 0
    assert [r.token for r in t.where("id = 4").orderBy("tok_idx").collect()] == ["né", "😀", "x"]
    b = tokens.byte_offsets(t).where("id = 4").orderBy("tok_idx").collect()
    assert [(r.start_byte, r.end_byte) for r in b] == [(0, 3), (4, 8), (9, 10)]
    assert [r.token for r in tokens.web_token_table(spark.createDataFrame([(1, "Café don't_x")], "id long, text string"), "id").orderBy("tok_idx").collect()] == ["caf", "é", "don", "'", "t_x"]
    assert tokens.run_table(df, "id").where("id = 5").count() == 0
    assert tokens.run_table(df, "id").groupBy("id").agg(F.count("*").alias("n")).where("id = 1").first().n == 3


def test_a_task_sends_tokens_on_as_it_goes():
    """One batch of many texts is answered in parts of bounded size, the same as text by text."""
    import pyarrow as pa

    from verbaline.functions import rules

    texts = ["né 😀 x,  (y) " * 900, None, "", " a", "plain " * 60_000] + ["w1 w2. " * 300] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "t"])
    parts = list(rules.token_rows(by_bytes=True)([batch]))
    assert len(parts) > 3 and max(p.num_rows for p in parts) <= rules.SEND + 60_000
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    want = [(i, k, a, b, bool(c), t[a:b], len(t[:a].encode()), len(t[:b].encode())) for i, t in enumerate(texts) if i in (0, 3, 7) for k, (a, b, c) in enumerate(tokenize(t, {}))]
    assert [r for r in rows if r[0] in (0, 3, 7)] == want
    assert sum(p.num_rows for p in rules.packed_rows()([batch])) == len(texts) and len(list(rules.packed_rows()([batch]))) > 3
    runs = [r for p in rules.run_rows([batch]) for r in p.to_pylist()]
    for i in (0, 1, 2, 3, 7):
        of = [r for r in runs if r["id"] == i]
        assert "".join(r["run"] for r in of) == (texts[i] or "") and [r["run_idx"] for r in of] == list(range(len(of)))
        assert all(r["run"].isspace() == r["is_space"] and texts[i][r["start"] :].startswith(r["run"]) for r in of)
