"""Token alignment, licence scan and fill-in-the-middle against plain loops, with nulls, empty, long and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import differences, duck
from tablegauge.llm import fill_middle, licences, token_align
from tablegauge.llm.queries import ORACLES, QUERIES, vocabulary
from tablegauge.session import ship_package

SF = "/root/testdata/sf0.001"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "a▁b", "tab\tline\n\n next\r\n", "é ﬁ Ⅷ 漢字かな 😀😀 ÿ", "<|endoftext|> <s> </s> <unk> <0x0A>", "　wide x ", "don't we'LL 3.14 x=[1,2];", "=" * 300,
       "\x00\x01 nul", "ａｂｃ", "العربية हिन्दी", "é́", "<P>mark", "ends with space ", "\n", "\n\n  \n word"]


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def docs(spark):
    """Null and odd texts, one of 1.2 million characters, repeated ids, null ids, and columns with names that results have."""
    plain = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    long = " ".join(random.Random(1).choices(["word", "naïve", "x1", "the", "licence", "漢字"], k=240_000))
    rows = [(k, t) for k, t in enumerate([None, *ODD, *plain, long])] + [(3, "again"), (3, "again"), (None, "null id")]
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, n int, groups string, row string").repartition(3)


def texts_of(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# ---- alignment


@pytest.fixture(scope="module")
def two():
    return token_align.TwoVocabularies(A, B)


def plain_alignment(two, text: str | None) -> dict:
    """Groups and links of one text, encoded whole, by the bytes of its tokens."""
    none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "links": Counter()}
    if not text:
        return none
    a = two.a.encode(" " + text, add_special_tokens=False).ids
    b = two.b.encode(text)
    a_raw, b_raw = [two.a_bytes[i] for i in a], [two.b_bytes[i] for i in b]
    if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
        return none
    a_ends, b_ends = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
    both = sorted({*a_ends} & {*b_ends})
    groups, low = [], 0
    for high in both:
        groups.append(([i for i, e in zip(a, a_ends) if low < e <= high], [i for i, e in zip(b, b_ends) if low < e <= high]) if len(a) < 3000 else None)
        low = high
    if groups[0] is None:  # as above, in one pass
        i = j = 0
        for k, high in enumerate(both):
            i2, j2 = i, j
            while i2 < len(a) and a_ends[i2] <= high:
                i2 += 1
            while j2 < len(b) and b_ends[j2] <= high:
                j2 += 1
            groups[k] = a[i:i2], b[j:j2]
            i, j = i2, j2
    links = Counter((x, y) for g, h in groups for x in g for y in h)
    return {"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": sum(links.values()),
            "groups": ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups), "links": links}


def plain_links(two, rows: list[tuple]) -> list[tuple]:
    found = [(i, plain_alignment(two, t)) for i, t in rows]
    counts = Counter(p for _, f in found for p in f["links"])
    most: dict[int, int] = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(i, f["n_a"], f["n_b"], f["n_groups"], f["n_links"], sum(n for p, n in f["links"].items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in f["links"].items()),
             hashlib.sha256(f["groups"].encode()).hexdigest() if f["groups"] else "") for i, f in found]


FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most_sent", [0, 300, 1 << 19])
def test_token_links_against_whole_texts(spark, docs, two, most_sent):
    """Also where the counts of most pairs are not sent to the tasks."""
    got = [tuple(r) for r in token_align.token_links(docs, A, B, most_sent).select(*FIGURES).collect()]
    assert sorted(got, key=repr) == sorted(plain_links(two, texts_of(docs)), key=repr)


def test_token_links_of_the_table(spark, two):
    got = [tuple(r) for r in QUERIES["op11_token_align"](spark, SF).select(*FIGURES).collect()]
    assert sorted(got) == sorted(plain_links(two, texts_of(spark.read.parquet(f"{SF}/documents.parquet"))))


def test_groups_are_returned(docs, two):
    got = {(r["doc_id"], r["groups"]) for r in token_align.align_tokens(docs, A, B).collect()}
    assert got == {(i, plain_alignment(two, t)["groups"]) for i, t in texts_of(docs)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eÉ漢😀\n\t,.'12=▁́ 　<|>"), max_size=25), min_size=1, max_size=6))
def test_alignment_of_any_text(two, texts):
    aligned = token_align.Alignment(two)
    raw = [(" " + t).encode() if t else b"" for t in texts]
    for _ in range(2):  # pieces that are new, then known
        figures, groups, bounds, pairs, links = aligned.block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, t in enumerate(texts):
            want = plain_alignment(two, t)
            assert [int(f[k]) for f in figures] == [want["n_a"], want["n_b"], want["n_groups"], want["n_links"]]
            assert groups[k] == want["groups"]
            own = slice(bounds[k], bounds[k + 1])
            assert {(p >> 20, p & (1 << 20) - 1): n for p, n in zip(pairs[own].tolist(), links[own].tolist())} == want["links"]


def test_workers_may_forget(two, monkeypatch):
    """A full memory of pieces starts anew and changes nothing."""
    for name in ("MOST_PIECES", "MOST_BYTES", "MOST_PAIRS"):
        monkeypatch.setattr(token_align, name, 10)
    aligned = token_align.Alignment(two)
    for text in ["one two three four five six seven", "eight nine ten", "one two ten"]:
        raw = (" " + text).encode()
        assert aligned.block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1] == [plain_alignment(two, text)["groups"]]


def test_multibyte_tokens_are_refined(two):
    """Offsets in characters and spans of byte-fallback tokens are too coarse here; ends follow the bytes."""
    for piece in ["😀", "漢Ⅷ", "ẍ́", "ﬁ"]:
        for ids, ends, raw in ((*two.a_tokens([piece], [piece.encode()], False), two.a_bytes), (*two.b_tokens([piece], [piece.encode()]), two.b_bytes)):
            assert ends.tolist() == np.cumsum([len(raw[i]) for i in ids.tolist()]).tolist()


# ---- licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text: str | None) -> tuple:
    words = words_of(text)
    places = [(k, label) for p, label in licences.PHRASES.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases_against_a_plain_search(spark, docs):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate([
        "GNU gnu General  Public,License GNU general public license", "cc by", "cc", "CC-BY cc BY", "mit-License. MIT LICENSE", "the mit license" * 50, "x" * 3_000_000, "the software " * 2000])], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").unionByName(more), spark.read.parquet(f"{SF}/documents.parquet")):
        got = [tuple(r) for r in licences.licence_labels(licences.find_licences(df)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
        assert sorted(got, key=repr) == sorted([(i, *plain_base(t)) for i, t in texts_of(df)], key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=40))
def test_matching_statistics_against_all_runs(texts, words):
    automaton = licences.Automaton(texts)
    known = {tuple(t[a:b]): None for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    for k, (state, length) in enumerate(automaton.read(words)):
        want = max((n for n in range(k + 2) if n == 0 or tuple(words[k + 1 - n:k + 1]) in known), default=0)
        assert length == want
        if length:
            run = words[k + 1 - length:k + 1]
            assert set(automaton.ends[state]) == {(t, e) for t, own in enumerate(texts) for e in range(length, len(own) + 1) if own[e - length:e] == run}


def spans_of(spark, text: str) -> list[tuple]:
    row = licences.find_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    return [(s["label"], s["start"], s["end"], s["covered"]) for s in row["spans"] if not s["base"]]


def test_changed_and_embedded_templates_are_found(spark):
    mit = licences.TEMPLATES["mit"][2].split()
    assert spans_of(spark, " ".join(["intro"] * 7 + mit)) == [("mit", 7, 7 + len(mit), len(mit))]
    changed = mit[:40] + ["ACME", "INC"] + mit[43:90] + mit[95:]
    (found,) = [s for s in spans_of(spark, " ".join(changed)) if s[0] == "mit"]
    assert found == ("mit", 0, len(changed), len(mit) - 8)
    assert [s[0] for s in spans_of(spark, " ".join(mit + ["between"] * 30 + mit))] == ["mit", "mit"]
    assert spans_of(spark, "the software is provided with the rights to use of the copyright holders and so on") == []
    assert spans_of(spark, " ".join(mit[::-1])) == []


def test_every_template_finds_itself(spark):
    rows = [(label, t) for label, own in licences.TEMPLATES.items() for t in own]
    found = licences.find_licences(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    for r in found:
        assert rows[r["doc_id"]][0] in {s["label"] for s in r["spans"]} and r["score"] == 1.0


def test_clean_prose_has_no_licence(spark):
    for r in licences.licence_labels(licences.find_licences(spark.read.parquet(f"{SF}/documents.parquet"))).collect():
        assert 0 <= r["score"] <= 1 and ((r["score"] > 0.5) == (r["labels"] != "")) and {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")}


# ---- fill-in-the-middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_fim(doc_id, text: str | None) -> tuple:
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_loops(spark, docs):
    rows = [(k, f"word{k}, naïve\nÉ 😀 x" * (k % 7)) for k in range(300)]
    for df in (docs, spark.createDataFrame(rows, "doc_id long, text string")):
        moved = fill_middle.fill_in_middle(df)
        want = [plain_fim(i, t) for i, t in texts_of(df)]
        assert sorted((tuple(r) for r in moved.collect()), key=repr) == sorted(want, key=repr)
        back = [r[0] for r in moved.select(fill_middle.restore(moved["form"], moved["output"])).collect()]
        assert sorted(back) == sorted(t or "" for _, t in texts_of(df))
        assert len({w[2] for w in want}) == 3


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abZ é1\n😀"), max_size=60), st.integers(1, 20))
def test_units_in_stretches(text, most):
    """Long texts are matched in stretches; the units are those of one match."""
    assert fill_middle.unit_ends(text, most).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_fill_in_middle_against_duckdb(spark):
    assert differences(QUERIES["op13_fill_middle"](spark, SF), duck(SF), ORACLES["op13_fill_middle"]) == []


@pytest.mark.parametrize("run", [fill_middle.fill_in_middle, licences.find_licences, lambda d: token_align.token_links(d, A, B)])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0
