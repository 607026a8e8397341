"""Queries without SQL against plain versions of them, on the smallest tables."""

import hashlib
import json
from collections import defaultdict

from kgloom import catalog
from kgloom.catalog import triple_queries as tq
from kgloom.catalog.views import spark_view
from kgloom.catalog.entity_queries import _rules
from tests.conftest import rows


def test_entity_json(spark, sf):
    want = defaultdict(lambda: defaultdict(set))
    for r in spark_view(spark, sf, "triples").collect():
        want[r.s][r.p].add(r.o)
    got = {r.s: json.loads(r.json) for r in catalog.queries()["c10_entity_json"](spark, sf).collect()}
    assert got == {s: {p: sorted(o) for p, o in ps.items()} for s, ps in want.items()}


def digest(seed, *ids):
    return hashlib.md5("|".join([str(seed), *ids]).encode()).hexdigest()


def test_type_targets(spark, sf):
    t = [tuple(r) for r in spark_view(spark, sf, "triples").collect()]
    targets, related, seed = {tq.CUSTOMER: 300, tq.COUNTRY: 5, tq.ORDER: 40}, 2, 42
    typed, near = defaultdict(set), defaultdict(set)
    for s, p, o, literal in t:
        if p in (tq.TYPE, "a") and o in targets:
            typed[o].add(s)
        if not literal and s != o:
            near[s].add(o), near[o].add(s)
    chosen = set()
    for i, kind in enumerate(sorted(typed, key=lambda k: (len(typed[k]), k))):
        missing = targets[kind] - len(typed[kind] & chosen)
        if missing > 0:
            new = sorted(typed[kind] - chosen, key=lambda s: (digest(seed + i, s), s))[:missing]
            chosen |= set(new)
            for s in new:
                chosen |= set(sorted(near[s], key=lambda n: (digest(seed + 1000 + i, s, n), n))[:related])
    got = catalog.queries()["l2_sample_type_targets"](spark, sf)
    assert rows(got.select("s", "p", "o", "isLiteral")) == sorted((r for r in t if r[0] in chosen), key=repr)


def test_hierarchy_tree(spark, sf):
    domain = {r["class"]: r.domain for r in _rules(spark, sf).collect()}
    children, has = defaultdict(set), set()
    for r in spark_view(spark, sf, "parents").collect():
        a, b = r["class"], r.parent
        if a in domain and domain.get(b) == domain[a]:
            children[b].add(a), has.add(a)
    want, seen = [], set()

    def walk(path):
        seen.add(path[-1])
        want.append((domain[path[0]], "/".join(path), len(path) - 1))
        for c in sorted(children[path[-1]]):
            if c not in path:
                walk([*path, c])

    for c in sorted(set(domain) - has):
        walk([c])
    want += [(d, f"~{c}", 0) for c, d in domain.items() if c not in seen]
    assert rows(catalog.queries()["g7_hierarchy_tree"](spark, sf)) == sorted(want, key=repr)
