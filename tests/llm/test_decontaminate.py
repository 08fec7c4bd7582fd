import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import LOWER, documents, none, rows
from veritab.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(doc, items, window=10):
    w, hit, found = ws(doc), set(), set()
    for i, t in items:
        v = ws(t)
        n = min(window, len(v))
        parts = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in parts:
                hit |= set(range(k, k + n))
                found.add(str(i) if i is not None else "null")
    names = sorted(found)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=14), min_size=1, max_size=5), st.text(alphabet="abcd ", max_size=40), st.integers(1, 4))
def test_automaton(items, doc, window):
    named = [(str(k), dc.item_words(t.encode())) for k, t in enumerate(items) if t.split()]
    spans, found = dc.SuffixAutomaton(named, window).hits(dc.item_words(doc.encode()))
    want = brute(doc, list(enumerate(items)), window)
    assert (sum(e - s for s, e in spans), len(found)) == want[1:3]


def test_documents(spark):
    texts = [r[1] for r in rows() if r[1] and len(r[1].split()) > 40]
    items = [(1, " ".join(texts[0].split()[5:30])), (2, "two words"), (2, "two words"), (None, " ".join(texts[1].split()[:12]).upper()), (3, ""), (4, None), (5, "same " * 10), (6, "a b")]
    items += [(10 + i, " ".join(t.split()[10:25])) for i, t in enumerate(texts[5:9])]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, row string")
    want = sorted((str(r[0]), *brute(r[1], items)) for r in rows())
    for block in (500_000, 20, 5):
        got = dc.contamination(documents(spark), bench, block_words=block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert {r.n_hit for r in dc.contamination(documents(spark), bench.where("false")).collect()} == {0}
    assert dc.contamination(none(spark), bench).count() == 0
    for block in (500_000, 20):
        cut = dc.decontaminate(documents(spark), bench, block_words=block)
        assert cut.columns == documents(spark).columns
        left = sorted((str(r.doc_id), str(r.text)) for r in cut.collect())
        kept = [r for r in rows() if brute(r[1], items)[1] <= 0.5 * len(ws(r[1]))]
        assert len(left) == len(kept)
        assert {x for x in left if x in {(str(r[0]), str(r[1])) for r in rows()}} >= {(str(r[0]), str(r[1])) for r in kept if not brute(r[1], items)[1]}


def test_cut():
    assert dc.without_spans("A, b! c-d e.", [(1, 3)]) == "A, -d e."
