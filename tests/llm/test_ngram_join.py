from collections import Counter, defaultdict

from peneira.llm import ngram_join as J


def brute(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    first, copy, inv, links = {}, {}, defaultdict(set), defaultdict(set)
    for i in sorted(sets):
        copy[i] = first.setdefault(sets[i], i) if sets[i] else i
    for i in set(copy.values()):
        for x in sets[i]:
            inv[x].add(i)
    for i in set(copy.values()):
        for j, k in Counter(j for x in sets[i] for j in inv[x] if j != i).items():
            if k >= threshold * (len(sets[i]) + len(sets[j]) - k) - 1e-9:
                links[i].add(j)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        return min(seen)

    return {i: (least(copy[i]), copy[i], len(links[copy[i]])) for i in sets}


def test_equals_brute_force(edges, edge_rows):
    rows = J.near_duplicates(edges).collect()
    assert len(rows) == len(edge_rows)
    # the row without an id goes by a number after all others
    got = {min(r.doc_id, 1 << 62): tuple(r)[1:4] for r in rows}
    want = brute([(1 << 62 if r[0] is None else r[0], r[1]) for r in edge_rows])
    assert {i: v[0] for i, v in want.items()} == {i: v[0] for i, v in got.items()} and want[1 << 62][0] == 9
    assert {i: v for i, v in got.items() if i < 1 << 62} == {i: v for i, v in want.items() if i < 1 << 62}
    assert len({v[0] for v in want.values()}) < len(want)


def test_blocks_and_chains(spark, monkeypatch):
    """A group larger than a block, whose ends are linked only through others."""
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 120])) for i in range(60)] + [(100 + i, " ".join(words[:120])) for i in range(30)]
    got = {r.doc_id: tuple(r)[1:4] for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows) and {v[0] for v in got.values()} == {0}


def test_bands_reach_recall():
    bands, rows = J.bands_for(0.8, 0.9995, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


def test_empty(empty):
    assert J.near_duplicates(empty).count() == 0


def test_texts_that_share_an_id(spark):
    """Rows go by id and text, in whatever order they come."""
    words = [f"w{i}" for i in range(300)]
    a, b = " ".join(words[:100]), " ".join(words[150:250])
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (None, a + " y"), (None, "else"), (2, a + " x"), (4, None), (4, "")]
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = J.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == len(rows)
        named = {}
        for r in got:
            assert named.setdefault(r.name, (r.doc_id, r.mark)) == (r.doc_id, r.mark)
        groups = {}
        for r in got:
            groups.setdefault(r.class_id, set()).add((min(r.doc_id, 1 << 62), r.n_links))
        seen.add(frozenset(frozenset(g) for g in groups.values()))
        names = sorted(named)
        assert [named[n][0] for n in names] == sorted(x for x, _ in named.values())
    assert len(seen) == 1
    # the one with text A: itself, 2 and the one without an id; the one with B: itself and 3
    assert {frozenset(i for i, _ in g) for g in next(iter(seen))} == {frozenset({1, 2, 1 << 62}), frozenset({1, 3}), frozenset({1 << 62}), frozenset({4})}
