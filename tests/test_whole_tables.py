"""Rows that the SQL twins of c7_redact_text, c8_clean_reply, c9_split_speaker and l1_wrap leave out, by hand."""

import hashlib

import pytest

from quirefold.plans.queries import QUERIES

DOCUMENTS = {
    1: ("see https://a.example/x?key=1#y now", "see https://a.example/x?[redacted] now"),
    2: ("http://me:pw@b.example/z\nend", "http://[redacted]@b.example/z\\nend"),
    3: ("ftp://c.example password: hunter22", "ftp://c.example password: [redacted]"),
    4: ("no address", "no address"),
}
LINE = "well-known " * 6 + "x" * 30 + "-" + "y" * 30
TURNS = [" both ends ", "\nfirst", "[note]: body", "[a] - b", LINE.strip(), "plain", "   ", "say \"so\" "]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, a) for k, (a, _) in DOCUMENTS.items()], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    turns = [(i, t, "user", x) for i, x in enumerate(TURNS) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_redact_text(spark, tables):
    got = {r["doc_id"]: r["digest"] for r in QUERIES["c7_redact_text"](spark, tables).collect()}
    assert got == {k: hashlib.md5(b.encode()).hexdigest() for k, (_, b) in DOCUMENTS.items()}


def test_clean_reply(spark, tables):
    got = {(r["conv_id"], r["turn"]): r["reply"] for r in QUERIES["c8_clean_reply"](spark, tables).collect()}
    assert len(got) == 4 * len(TURNS)
    for i, x in enumerate(TURNS):
        assert got[i, 0] == x.strip(" "), x
        assert got[i, 1] == x.strip(), x
        assert got[i, 2] is None
        assert got[i, 3] == (f'"{x}"' if '"' in x else x.strip(" ")), x


def test_split_speaker(spark, tables):
    got = {(r["conv_id"], r["turn"]): (r["tag"], r["label"], r["body"]) for r in QUERIES["c9_split_speaker"](spark, tables).collect()}
    for i, x in enumerate(TURNS):
        inner = x.startswith("[note]")
        body = "body" if inner else x.lstrip()
        assert got[i, 0] == (("note", None, body) if inner else ("user", "user", body)), x
        assert got[i, 1] == (("note", None, body) if inner else ("A user", None, body)), x
        assert got[i, 2] == (("note", None, body) if inner else (None, None, x)), x
    assert len(got) == 4 * len(TURNS)


def test_wrap(spark, tables):
    def lines(text):
        out = [""]
        for word in text.split():
            cut = word.index("-") + 1 if len(word) > 38 else len(word)
            for gap, piece in ((" ", word[:cut]), ("", word[cut:])):
                lead = gap if out[-1] else ""
                if not piece:
                    continue
                if out[-1] and len(out[-1]) + len(lead) + len(piece) > 38:
                    out.append(piece)
                else:
                    out[-1] += lead + piece
        return out

    got = {(r["conv_id"], r["turn"]): (r["lines"], r["longest"], r["last"]) for r in QUERIES["l1_wrap"](spark, tables).collect()}
    want = {i: lines(x) for i, x in enumerate(TURNS) if x.strip()}
    assert got == {(i, t): (len(x), max(map(len, x)), x[-1]) for i, x in want.items() for t in range(4)}
