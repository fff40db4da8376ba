"""Single steps of the clustering, on made similarities."""

import math

from helixmill.functions.parameters import calibration_budget
from helixmill.operators import clustering


def test_augmentation_keeps_its_budget():
    """Unseen pairs are scored until enough are positive, within ln(n) cubed."""
    n = 400
    asked = []
    none = clustering.Similarities(lambda a, b: asked.append((a, b)) or 0.0)
    out = clustering._more_pairs(clustering.Node(list(range(n)), 1), none, set(range(n)))
    assert len(out) == len(set(out)) == len(asked) == calibration_budget(n) == math.ceil(math.log(n) ** 3)
    some = clustering.Similarities(lambda a, b: 0.5)
    assert len(clustering._more_pairs(clustering.Node(list(range(n)), 1), some, set(range(n)))) == clustering.WANTED_POSITIVES
    known = clustering.Similarities(lambda a, b: 0.5)
    known.register((0, i) for i in range(1, 31))
    more = clustering._more_pairs(clustering.Node(list(range(n)), 1), known, set(range(n)))
    assert len(more) == 2 and not set(more) & known.registry
    few = clustering.Similarities(lambda a, b: 0.5)
    assert len(clustering._more_pairs(clustering.Node([0, 1, 2], 1), few, {0, 1, 2})) <= 3


def test_pairs_are_scored_once():
    asked = []
    similar = clustering.Similarities(lambda a, b: asked.append((a, b)) or (0.5 if (a + b) % 2 else 0.0))
    assert similar.of(3, 1) == similar.of(1, 3) == 0.0 and similar.of(1, 2) == 0.5 and asked == [(1, 3), (1, 2)]
    similar.register([(2, 1), (5, 1)])
    assert asked == [(1, 3), (1, 2), (1, 5)] and similar.registry == {(1, 2), (1, 5)}
    assert similar.within({1, 2, 3}) == [0.5] and similar.calibration({1, 2, 5}) == ([0.5], 1)


def test_leaders():
    """Where all of a family are as alike as can be, and families share nothing, leaders are as many as families."""
    n, families = 60, 4
    similar = clustering.Similarities(lambda a, b: 0.9 if a % families == b % families else 0.0)
    node = clustering.Node(list(range(n)), 7)
    clusters, loose = clustering._lead(node, similar, [0.9], 30)
    assert not loose and sorted(map(sorted, clusters)) == [list(range(f, n, families)) for f in range(families)]
    clusters, loose = clustering._lead(node, similar, [0.9], 3)  # no more leaders than the limit, the others wait
    assert len(clusters) == 3 and sorted(i for c in clusters for i in c) + sorted(i for x in loose for i in x) and sum(map(len, clusters)) + len(loose) == n
    assert len({c[0] % families for c in clusters}) == 3 and len({x[0] % families for x in loose}) == 1
    alone, _ = clustering._lead(node, clustering.Similarities(lambda a, b: 0.0), [0.9], n)
    assert sorted(alone) == [[i] for i in range(n)]


def test_second_pass():
    """The best score of a cluster's panel decides, the first of equals; then the second sketch; then a draw."""
    kept = [[1, 2, 3], [4, 5, 6], [7, 8]]
    node = clustering.Node(list(range(10)), 3)
    score = lambda best: clustering.Similarities(lambda a, b: best.get(max(a, b), 0.0))
    assert clustering._nearest(node, score({7: 0.4, 8: 0.4}), None, 0, kept) == 2
    assert clustering._nearest(node, score(dict.fromkeys(range(1, 9), 0.4)), None, 0, kept) == 0
    assert clustering._nearest(node, score({}), lambda a, b: 0.2 if b in (4, 5, 6) else 0.1, 0, kept) == 1
    drawn = [clustering._nearest(clustering.Node(list(range(10)), s), score({}), lambda a, b: 0.0, 0, kept) for s in range(60)]
    assert set(drawn) == {0, 1, 2}


def test_small_nodes():
    similar = clustering.Similarities(lambda a, b: 0.0)
    assert clustering.cluster_genomes(range(9), similar, (0.4, 0.1)) == [list(range(9))]
    halves = clustering.cluster_genomes(range(40), similar, (0.4, 0.1))
    assert len(halves) == 2 and sorted(map(len, halves)) == [20, 20]
