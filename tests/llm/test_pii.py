import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, none, rows
from veritab.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.1250-+ (é\n", max_size=40))
def test_base_spans(t):
    assert pii.base_spans(t) == brute(t)


def test_every_row_and_odd_texts(spark):
    got = sorted((r.doc_id or -1, r.base, r.spans) for r in pii.find_pii(documents(spark)).collect())
    want = sorted((d or -1, pii.joined(brute(t or ""))) for d, t, *_ in rows())
    assert [(d, b) for d, b, _ in got] == want
    assert pii.find_pii(none(spark)).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    docs = [(i, f"please write to my address contact me at user{i}@mail{i}.org today") for i in range(12)]
    docs += [(100, "you can contact me at someone(at)place today"), (101, "look at 12 things, me at home"), (102, "no contact here")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string"), support=5, confident=0.7).collect()}
    at = docs[12][1].index("someone")
    assert got[100].base == "" and got[100].spans == f"email:{at}:{at + len('someone(at)place')}"
    assert got[101].spans == "" and got[3].spans == got[3].base != ""
    assert got[100].n_spans == 1 and got[102].n_spans == 0


def test_patterns_find_written_forms_and_glued_identifiers(spark):
    docs = [(i, f"please contact me at user{i}@mail{i}.org today or call me on +1 (706) 555-31{i:02} and my mail:u{i}@h{i}.net too") for i in range(12)]
    forms = {100: "(743) 555-3824", 101: "743 555 3824", 102: "john at example dot com", 103: "john [at] example [dot] com", 104: "j.doe at example.com", 105: "743.555.3824"}
    for i, f in forms.items():
        docs.append((i, f"you can {'contact me at' if ' at' in f or '[at' in f else 'call me on'} {f}, thanks"))
    docs += [(200, "write to my mail:jane(at)place, thanks"), (201, "my mail:none was sent")]
    # the forms before count for their patterns, not against them
    found = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string"), support=5, confident=0.8)
    got = {r.doc_id: r for r in found.collect()}
    for i, f in forms.items():
        t = dict(docs)[i]
        assert got[i].base == "" and got[i].spans == f"{'email' if 'j' in f else 'phone'}:{t.index(f)}:{t.index(f) + len(f)}"
    assert got[200].spans == "email:17:30" and got[201].spans == ""
    assert all(got[i].spans == got[i].base for i in range(12))


def spans_of(t, kind):
    return [t[s:e] for s, k, e in pii.candidates(t, pii.base_spans(t)) if k == kind]


def test_candidates():
    card = "4111 1111 1111 1112"
    assert card in spans_of(f"card {card} ok", 2) and "(555 123 4567)" not in spans_of("(555 123 4567", 3) and "555 123 4567" in spans_of("(555 123 4567", 3)
    assert spans_of("a (743) 555-3824.", 3) == ["(743) 555-3824"]
    assert spans_of("look at home. Then go", 0) == spans_of("people at work", 0) == []
    assert spans_of("me.too [at] host (dot) org!", 0) == ["me.too [at] host (dot) org"]
    assert spans_of("x fe80::1:2:3 y 12:30:45", 1) == ["fe80::1:2:3"]
    # a base match that fails leaves its parts
    assert "4111111111111111" in spans_of("pay 4111111111111111 2024", 2) and not pii.base_spans("pay 4111111111111111 2024")
    assert spans_of("a1234567890b 0x1234567890", 3) == [] and spans_of("1 " * 40, 3) == []


TOKEN = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^\sA-Za-z0-9\u0080-\U0010ffff]")


def plain(t):
    return re.sub("[0-9]", "0", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB1 9.:é(\n", max_size=25), min_size=1, max_size=4))
def test_tokens_and_runs(texts):
    w = pii.tokens(pa.array(texts, pa.large_string()))
    g = pii.grams(w)
    at, seen = 0, {}
    for t in texts:
        ts = [plain(m[0]) for m in TOKEN.finditer(t)]
        got = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.first[at] : w.first[at + 1]], w.ends[w.first[at] : w.first[at + 1]])]
        assert got == ts
        for i in range(len(ts)):
            for k in range(3):
                if i + k < len(ts):
                    assert seen.setdefault((k, *ts[i : i + k + 1]), int(g[k][w.first[at] + i])) == int(g[k][w.first[at] + i])
        at += 1
    assert len(set(seen.values())) == len(seen)


def test_run_counts(spark):
    texts = [t for _, t, *_ in rows() if t and len(t) < 20_000]
    want = Counter()
    for t in texts:
        w = pii.tokens(pa.array([t], pa.large_string()))
        for k, g in enumerate(pii.grams(w)):
            want.update(g[: max(0, len(w.starts) - k)].view(np.int64).tolist())
    every = np.full(1 << (pii._BITS - 3), 255, np.uint8)
    got = pii.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), every).collect()
    assert {r.pattern: r.total for r in got} == dict(want)


def scores(edges, totals, support, confident, rounds):
    """The graph's rounds in plain Python."""
    keys = {e[:3] for e in edges}
    total = {k: max(sum(n for *p, _, n, _ in edges if tuple(p) == k), totals.get(k[2], 0) if k[1] < pii.GRAMS else 0) for k in keys}
    score, good = {e[:4]: float(e[5]) for e in edges}, {e[:4]: e[5] for e in edges}
    for _ in range(rounds):
        mass, held = defaultdict(float), Counter()
        for e in edges:
            mass[e[:3]] += e[4] * score[e[:4]]
            held[e[:3]] += good[e[:4]]
        sure = {k: mass[k] / total[k] for k in keys if held[k] >= support}
        for e in edges:
            mine = [f[:3] for f in edges if f[0] == e[0] and f[3] == e[3]]
            wrong = 1.0
            for k in mine:
                if k != e[:3] and k in sure:
                    wrong *= max(1e-9, 1 - sure[k])
            score[e[:4]] = 1.0 if e[5] else 1 - wrong
            good[e[:4]] = e[5] or max((sure.get(k, 0) for k in mine), default=0) >= confident
    return sure


def test_graph_scores(spark):
    rng = random.Random(4)
    seeds = {(k, i): rng.random() < 0.5 for k in range(2) for i in range(12)}
    met = {(rng.randrange(2), rng.randrange(7), rng.randrange(5), rng.randrange(12)) for _ in range(150)}
    edges = [(*m, rng.randint(1, 4), seeds[m[0], m[3]]) for m in sorted(met)]
    totals = {p: rng.randint(1, 60) for p in range(4)}
    e = spark.createDataFrame(edges, "kind int, slot int, pattern long, instance long, n long, seed boolean")
    t = spark.createDataFrame(list(totals.items()), "pattern long, total long")
    for rounds in (1, 2, 4):
        got = {(r.kind, r.slot, r.pattern): r.confidence for r in pii.score_graph(e, t, 2, 0.5, rounds).collect()}
        want = scores(edges, totals, 2, 0.5, rounds)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # an accepted candidate lets a pattern count that seeds alone don't carry
    more = [(0, 0, 1, i, 1, True) for i in range(9)] + [(0, 0, 1, 20, 1, False), (0, 0, 2, 20, 1, False), (0, 0, 2, 0, 1, True), (0, 0, 2, 21, 1, False)]
    e = spark.createDataFrame(more, "kind int, slot int, pattern long, instance long, n long, seed boolean")
    first, second = ({r.pattern for r in pii.score_graph(e, t.limit(0), 2, 0.8, k).collect()} for k in (1, 2))
    assert first == {1} and second == {1, 2}
