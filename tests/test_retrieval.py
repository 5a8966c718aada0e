from __future__ import annotations

from kordex.operators import retrieve


def test_common_tokens_bring_candidates(spark):
    asked = [f"w{k}" for k in range(12)]
    items = {0: asked[8:], 1: asked[:8], 2: ["other"], **{k: asked[8:] + [f"x{k}"] for k in range(3, 20)}}
    q = spark.createDataFrame([(1, asked)], "query_id long, tokens array<string>")
    got = retrieve.postings(q, spark.createDataFrame(list(items.items()), "row_idx long, tokens array<string>")).collect()
    want = {(k, len(set(asked) & set(t)), 12, len(t)) for k, t in items.items() if set(asked) & set(t)}
    assert {(r.row_idx, r.shared, r.q_size, r.i_size) for r in got} == want and len(got) == len(want)


def test_top_lists_equal_brute_force(spark):
    """Whole lists, ties and all, against a plain loop; so the recall of the top 5 is 1."""
    words = [f"t{k}" for k in range(40)]
    pick = lambda seed, n: [words[(seed * 7 + j * j * (seed % 5 + 1)) % 40] for j in range(n)]
    asked, offered = {q: pick(q, 6) for q in range(8)}, {d: pick(d + 3, 1 + d % 17) for d in range(120)}
    frame = lambda rows, key: spark.createDataFrame([(k, x) for k, x in rows.items()], f"{key} long, tokens array<string>")
    met = retrieve.postings(frame(asked, "query_id"), frame(offered, "row_idx"))
    got = {(r.query_id, r["rank"]): r.row_idx for r in retrieve.top_k(met.withColumn("score", retrieve.jaccard_of(met.shared, met.q_size, met.i_size)), 5).collect()}
    for q, a in asked.items():
        scored = sorted((-len(set(a) & set(b)) / len(set(a) | set(b)), d) for d, b in offered.items() if set(a) & set(b))
        assert [got.get((q, k + 1)) for k in range(5)] == [d for _, d in scored[:5]] + [None] * (5 - len(scored[:5]))
