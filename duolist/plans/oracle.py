"""The registered queries in DuckDB SQL, over common table expressions that rebuild the demonstration tables."""

from __future__ import annotations

_BASE = {
    "ratings": """SELECT userId, movieId, rating, timestamp FROM (
        SELECT o_custkey AS userId, l_partkey AS movieId, ceil(l_quantity / 5) / 2 AS rating, CAST(epoch(l_shipdate) AS BIGINT) AS timestamp,
               row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, ceil(l_quantity / 5) DESC) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE n = 1""",
    "movies": "SELECT p_partkey AS movieId, p_name AS title, replace(p_name, ' ', '|') AS genres FROM part",
    "split": """SELECT *, CASE WHEN timestamp < 946684800 THEN 'train' WHEN timestamp < 973036800 THEN 'validation' ELSE 'test' END AS split,
        rating >= 4 AS is_positive FROM ratings""",
    "stats": """SELECT userId, """ + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_interactions, count(*) FILTER (split = '{s}' AND is_positive) AS {s}_positives" for s in ("train", "validation", "test")) + " FROM split GROUP BY userId",
    "training": "SELECT userId FROM stats WHERE train_positives >= 5",
    "evaluating": "SELECT userId FROM stats WHERE train_interactions >= 10 AND train_positives >= 3 AND validation_positives >= 1 AND test_positives >= 1",
    "edges": "SELECT DISTINCT userId, movieId FROM split WHERE split = 'train' AND is_positive AND userId IN (SELECT userId FROM training)",
    "catalog": "SELECT movieId, count(*) AS trainPositiveCount FROM edges GROUP BY movieId HAVING count(*) >= 5",
    "warm_edges": "SELECT userId, movieId FROM edges WHERE movieId IN (SELECT movieId FROM catalog)",
    "pairs": """SELECT CAST(i // 2 AS BIGINT) AS pairId, min(userId) AS userA, max(userId) AS userB FROM (
        SELECT userId, row_number() OVER (ORDER BY userId) - 1 AS i FROM evaluating) GROUP BY i // 2 HAVING count(*) = 2""",
    "members": "SELECT pairId, 'A' AS member, userA AS userId FROM pairs UNION ALL SELECT pairId, 'B', userB FROM pairs",
    "seen": "SELECT DISTINCT userId, movieId FROM split WHERE split IN ('train', 'validation') AND userId IN (SELECT userId FROM members)",
    "seen_pair": "SELECT DISTINCT pairId, movieId FROM members JOIN seen USING (userId)",
    "candidates": "SELECT p.pairId, userA, userB, c.movieId, trainPositiveCount FROM pairs p CROSS JOIN catalog c WHERE NOT EXISTS (SELECT 1 FROM seen_pair s WHERE s.pairId = p.pairId AND s.movieId = c.movieId)",
    "targets": "SELECT DISTINCT userId, movieId FROM split WHERE split = 'test' AND is_positive AND userId IN (SELECT userId FROM members)",
    "relevant": """SELECT pairId, userId, movieId FROM members m JOIN targets USING (userId) WHERE movieId IN (SELECT movieId FROM catalog)
        AND NOT EXISTS (SELECT 1 FROM seen_pair s WHERE s.pairId = m.pairId AND s.movieId = targets.movieId)""",
    "popular": """SELECT * FROM (SELECT pairId, userA, userB, row_number() OVER (PARTITION BY pairId ORDER BY trainPositiveCount DESC, movieId) AS rank, movieId,
        CAST(trainPositiveCount AS DOUBLE) AS score FROM candidates) WHERE rank <= 10""",
    "ideal": "SELECT n, sum(1 / log2(n2 + 1.0)) AS best FROM range(1, 11) a(n) JOIN range(1, 11) b(n2) ON n2 <= n GROUP BY n",
    "member_metrics": """SELECT r.pairId, r.userId, coalesce(sum(1 / log2(p.rank + 1.0)), 0) / any_value(best) AS ndcg, count(p.rank) / count(*) AS recall
        FROM (SELECT *, least(count(*) OVER (PARTITION BY pairId, userId), 10) AS n FROM relevant) r JOIN ideal USING (n)
        LEFT JOIN popular p ON p.pairId = r.pairId AND p.movieId = r.movieId GROUP BY r.pairId, r.userId""",
    "metrics": """SELECT p.pairId, p.userA, p.userB, a.ndcg AS ndcgA, b.ndcg AS ndcgB, a.recall AS recallA, b.recall AS recallB FROM pairs p
        JOIN member_metrics a ON a.pairId = p.pairId AND a.userId = p.userA JOIN member_metrics b ON b.pairId = p.pairId AND b.userId = p.userB
        WHERE p.pairId IN (SELECT pairId FROM popular)""",
    "rated_genres": "SELECT s.userId, unnest(list_distinct(string_split(genres, '|'))) AS genre, CAST(is_positive AS INT) AS liked FROM split s JOIN movies USING (movieId) WHERE split = 'train' AND userId IN (SELECT userId FROM members)",
    "rates": "SELECT userId, avg(CAST(is_positive AS INT)) AS rate FROM split WHERE split = 'train' AND userId IN (SELECT userId FROM members) GROUP BY userId",
    "profiles": """SELECT userId, genre, w / norm AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY userId)) AS norm FROM (
        SELECT g.userId, genre, (sum(liked) + 10 * any_value(rate)) / (count(*) + 10) - any_value(rate) AS w FROM rated_genres g JOIN rates USING (userId) GROUP BY g.userId, genre)) WHERE norm > 0""",
    "features": """SELECT p.*, coalesce(co, 0) AS coRatedTrain, CASE WHEN co >= 3 THEN r END AS ratingCorrelation, coalesce(sim, 0) AS genreSimilarity FROM pairs p
        LEFT JOIN (SELECT pairId, count(*) AS co, CASE WHEN stddev_pop(a.rating) * stddev_pop(b.rating) > 0 THEN covar_pop(a.rating, b.rating) / (stddev_pop(a.rating) * stddev_pop(b.rating)) END AS r
            FROM pairs JOIN split a ON a.userId = userA AND a.split = 'train' JOIN split b ON b.userId = userB AND b.movieId = a.movieId AND b.split = 'train' GROUP BY pairId) USING (pairId)
        LEFT JOIN (SELECT pairId, sum(a.weight * b.weight) AS sim FROM pairs JOIN profiles a ON a.userId = userA JOIN profiles b ON b.userId = userB AND b.genre = a.genre GROUP BY pairId) USING (pairId)""",
    "degrees": "SELECT movieId, count(*) AS d FROM warm_edges GROUP BY movieId",
    "co": """SELECT a.movieId AS src, b.movieId AS cand, count(*) / (sqrt(CAST(any_value(x.d) AS DOUBLE) * any_value(y.d)) + 10) AS similarity
        FROM warm_edges a JOIN warm_edges b ON a.userId = b.userId AND a.movieId < b.movieId JOIN degrees x ON x.movieId = a.movieId JOIN degrees y ON y.movieId = b.movieId
        GROUP BY a.movieId, b.movieId""",
    "neighbours": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, cand) AS rank FROM (
        SELECT src, cand, similarity FROM co UNION ALL SELECT cand, src, similarity FROM co)) WHERE rank <= 100""",
    "knn": """SELECT w.userId, cand AS movieId, sum(similarity) AS score FROM warm_edges w JOIN neighbours ON src = movieId AND rank <= 50
        WHERE w.userId IN (SELECT userId FROM members) GROUP BY w.userId, cand""",
    "scored": """SELECT c.pairId, c.userA, c.userB, c.movieId, coalesce(a.score, 0) AS scoreA, coalesce(b.score, 0) AS scoreB FROM candidates c
        LEFT JOIN knn a ON a.userId = userA AND a.movieId = c.movieId LEFT JOIN knn b ON b.userId = userB AND b.movieId = c.movieId""",
    "q": "SELECT *, "
    + ", ".join(f"(rank() OVER (PARTITION BY pairId ORDER BY round(score{m}, 9)) + (count(*) OVER (PARTITION BY pairId, round(score{m}, 9)) - 1) / 2) / count(*) OVER (PARTITION BY pairId) AS q{m}" for m in "AB")
    + " FROM scored",
    "nodes": "SELECT *, row_number() OVER (ORDER BY kind, id) - 1 AS node FROM (SELECT DISTINCT 0 AS kind, userId AS id FROM warm_edges UNION ALL SELECT DISTINCT 1, movieId FROM warm_edges)",
    "links": """SELECT u.node AS source, m.node AS target FROM warm_edges JOIN nodes u ON u.kind = 0 AND u.id = userId JOIN nodes m ON m.kind = 1 AND m.id = movieId
        UNION ALL SELECT m.node, u.node FROM warm_edges JOIN nodes u ON u.kind = 0 AND u.id = userId JOIN nodes m ON m.kind = 1 AND m.id = movieId""",
    "weighted": "SELECT source, target, 1 / sqrt(a.d * b.d) AS weight FROM links JOIN (SELECT source AS s, count(*) AS d FROM links GROUP BY 1) a ON a.s = source JOIN (SELECT source AS s, count(*) AS d FROM links GROUP BY 1) b ON b.s = target",
    "layer0": "SELECT node, CAST(node % 7 AS DOUBLE) AS value FROM nodes",
    "layer1": "SELECT target AS node, sum(weight * value) AS value FROM weighted JOIN layer0 ON node = source GROUP BY target",
    "layer2": "SELECT target AS node, sum(weight * value) AS value FROM weighted JOIN layer1 ON node = source GROUP BY target",
    "vec": "SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "folded": """SELECT userId, list(value ORDER BY pos) AS u FROM (SELECT userId, pos, sum((rating - 3.5) * v) / sum(rating - 3.5) AS value FROM split JOIN vec ON vec_id = movieId
        WHERE split = 'train' AND is_positive GROUP BY userId, pos) GROUP BY userId""",
    "items": "SELECT vec_id AS movieId, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "known": "SELECT * EXCLUDE (genreSimilarity, ratingCorrelation), round(genreSimilarity, 9) AS g, round(ratingCorrelation, 9) AS r FROM features WHERE ratingCorrelation IS NOT NULL",
    "conflicts": """SELECT pairId, ((rank() OVER (ORDER BY -g) + (count(*) OVER (PARTITION BY g) - 1) / 2) / count(*) OVER () + (rank() OVER (ORDER BY -r) + (count(*) OVER (PARTITION BY r) - 1) / 2) / count(*) OVER ()) / 2 AS score FROM known""",
    "banded": """SELECT pairId, score, CASE WHEN score <= (SELECT quantile_cont(score, CAST(1 AS DOUBLE) / 3) FROM conflicts) THEN 'low'
        WHEN score <= (SELECT quantile_cont(score, CAST(2 AS DOUBLE) / 3) FROM conflicts) THEN 'medium' ELSE 'high' END AS conflictBand FROM conflicts""",
    "preference": """SELECT genre, sum(rating - 3) / (count(*) + 2) AS pref FROM (SELECT unnest(list_distinct(string_split(genres, '|'))) AS genre, rating FROM own JOIN movies USING (movieId)) GROUP BY genre""",
    "own": "SELECT movieId, rating FROM split WHERE split = 'train' AND userId = (SELECT min(userA) FROM pairs) AND movieId IN (SELECT movieId FROM catalog)",
    "pool": "SELECT c.*, genres FROM catalog c JOIN movies USING (movieId) WHERE movieId NOT IN (SELECT movieId FROM own) ORDER BY trainPositiveCount DESC, movieId LIMIT 2000",
}
#: In the order in which each needs only those before it.
_ORDER = [n for n in _BASE if n not in ("own", "preference", "pool")] + ["own", "preference", "pool"]
#: Looked at several times: worked out once.
_ONCE = ("split", "warm_edges", "co", "neighbours")
_WITH = "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in _ONCE)}({_BASE[n]})" for n in _ORDER) + "\n"

_GROUP = """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY pairId ORDER BY round(groupScore, 9) DESC, round(minimumScore, 9) DESC, round(averageScore, 9) DESC, movieId) AS rank, 0 AS n FROM (
    SELECT pairId, movieId, {group} AS groupScore, least(qA, qB) AS minimumScore, (qA + qB) / 2 AS averageScore FROM q)) WHERE rank <= 10"""


def _top(group: str) -> str:
    return f"SELECT pairId, movieId, CAST(rank AS BIGINT) AS rank, round(groupScore, 6) AS group_score FROM ({_GROUP.format(group=group)})"


_MEANS = "round(avg((ndcgA + ndcgB) / 2), 6) AS mean_average_ndcg, round(avg(least(ndcgA, ndcgB)), 6) AS mean_minimum_ndcg, round(avg(abs(ndcgA - ndcgB)), 6) AS mean_ndcg_gap"

#: Every user with the next two by id, in the order of a hash.
_RING = """placed AS (SELECT userId, row_number() OVER (ORDER BY userId) - 1 AS i FROM evaluating),
        ring AS (SELECT 2 * a.i + s AS i, a.userId AS userA, b.userId AS userB FROM placed a CROSS JOIN range(2) r(s) JOIN placed b ON b.i = a.i + s + 1),
        numbered AS MATERIALIZED (SELECT userA, userB, row_number() OVER (ORDER BY CAST('0x' || substr(md5('7:' || i), 1, 13) AS BIGINT), i) AS n FROM ring)"""


def _greedily(cap: int) -> str:
    """Pairs of the ring one by one; busy holds the members of those taken before."""
    free = f"len([x FOR x IN t.busy IF x = c.userA]) < {cap} AND len([x FOR x IN t.busy IF x = c.userB]) < {cap}"
    return f"""WITH RECURSIVE {_RING}, taking AS (
        SELECT CAST(0 AS BIGINT) AS n, false AS taken, CAST(NULL AS BIGINT) AS userA, CAST(NULL AS BIGINT) AS userB, CAST([] AS BIGINT[]) AS busy
        UNION ALL SELECT c.n, {free}, c.userA, c.userB, CASE WHEN {free} THEN list_concat([c.userA, c.userB], t.busy) ELSE t.busy END
        FROM taking t JOIN numbered c ON c.n = t.n + 1)
        SELECT n - 1 AS pairId, userA, userB FROM taking WHERE taken"""


#: Members of the first hundred pairs that have likes, and others by hash up to four hundred.
_SUBSET = """WITH own AS (SELECT userA, userB FROM pairs WHERE pairId < 100 AND userA IN (SELECT userId FROM warm_edges) AND userB IN (SELECT userId FROM warm_edges)),
        focus AS (SELECT userA AS userId FROM own UNION SELECT userB FROM own),
        others AS (SELECT userId, row_number() OVER (ORDER BY CAST('0x' || substr(md5('7:' || userId), 1, 13) AS BIGINT)) AS n FROM (SELECT DISTINCT userId FROM warm_edges WHERE userId NOT IN (SELECT userId FROM focus))),
        chosen AS (SELECT userId, true AS focus FROM focus UNION ALL SELECT userId, false FROM others WHERE n <= 400 - (SELECT count(*) FROM focus))
        """

_SELECT = {
    "ratings_view": "SELECT userId, movieId, rating, timestamp FROM ratings",
    "temporal_split": "SELECT userId, movieId, split, is_positive FROM split",
    "split_summary": "SELECT split, count(*) AS interactions, count(DISTINCT userId) AS users, count(DISTINCT movieId) AS movies, round(avg(CAST(is_positive AS INT)), 9) AS positive_rate FROM split GROUP BY split",
    "user_split_statistics": "SELECT * FROM stats",
    "training_users": "SELECT * FROM training",
    "evaluation_users": "SELECT * FROM evaluating",
    "pretest_users": "SELECT userId FROM stats WHERE train_interactions >= 10 AND train_positives >= 3 AND validation_positives >= 1 AND userId NOT IN (SELECT userId FROM evaluating)",
    "positive_edges": "SELECT * FROM warm_edges",
    "positive_events": "SELECT userId, movieId FROM split WHERE split = 'validation' AND is_positive AND userId IN (SELECT userId FROM evaluating)",
    "warm_catalog": "SELECT * FROM catalog",
    "warm_coverage": "SELECT round(avg(CASE WHEN movieId IN (SELECT movieId FROM catalog) THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM split WHERE split = 'test' AND is_positive AND userId IN (SELECT userId FROM members)",
    "first_k": "SELECT userId, movieId, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY timestamp, movieId) AS n FROM ratings) WHERE n <= 5",
    "seen_items": "SELECT * FROM seen",
    "pair_candidates": "SELECT pairId, movieId FROM candidates",
    "missing_report": "SELECT * FROM (SELECT unnest(['userId', 'movieId', 'rating', 'timestamp']) AS \"column\", unnest([count(*) - count(userId), count(*) - count(movieId), count(*) - count(rating), count(*) - count(timestamp)]) AS missing, unnest([(count(*) - count(userId)) / count(*), (count(*) - count(movieId)) / count(*), (count(*) - count(rating)) / count(*), (count(*) - count(timestamp)) / count(*)]) AS fraction FROM ratings)",
    "duplicate_counts": "SELECT (count(*) - count(DISTINCT (o_custkey, l_partkey)))::BIGINT AS duplicates FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "value_checks": "SELECT count(*) FILTER (rating < 0.5 OR rating > 5 OR rating * 2 <> floor(rating * 2)) AS invalid_ratings, count(*) FILTER (userId <= 0) AS invalid_users, count(*) FILTER (movieId <= 0) AS invalid_movies FROM ratings",
    "referential_checks": "SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "time_range": "SELECT strftime(make_timestamp(min(timestamp) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS \"first\", strftime(make_timestamp(max(timestamp) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS \"last\" FROM ratings",
    "disjoint_pairs": "SELECT * FROM pairs",
    "joint_counts": "SELECT p.*, (SELECT count(*) FROM targets a JOIN targets b ON a.movieId = b.movieId WHERE a.userId = p.userA AND b.userId = p.userB) AS jointTestPositiveCount FROM pairs p",
    "genre_profiles": "SELECT userId, genre, round(weight, 6) AS weight FROM profiles",
    "pair_features": "SELECT pairId, userA, userB, coRatedTrain, round(genreSimilarity, 6) AS genre_similarity, round(ratingCorrelation, 6) AS rating_correlation FROM features",
    "similarity_bands": """SELECT pairId, CASE WHEN genreSimilarity <= (SELECT quantile_cont(genreSimilarity, CAST(1 AS DOUBLE) / 3) FROM features) THEN 'high_conflict'
        WHEN genreSimilarity <= (SELECT quantile_cont(genreSimilarity, CAST(2 AS DOUBLE) / 3) FROM features) THEN 'mixed' ELSE 'similar' END AS similarityBand FROM features""",
    "popularity_topk": "SELECT pairId, userA, userB, rank, movieId, score FROM popular",
    "pair_relevance": "SELECT * FROM relevant",
    "pair_metrics": "SELECT pairId, userA, userB, round(ndcgA, 6) AS ndcg_a, round(ndcgB, 6) AS ndcg_b, round((ndcgA + ndcgB) / 2, 6) AS average_ndcg, round(least(ndcgA, ndcgB), 6) AS minimum_ndcg, round((recallA + recallB) / 2, 6) AS average_recall FROM metrics",
    "method_summary": f"""SELECT count(*) AS evaluated_pairs, (SELECT count(DISTINCT pairId) FROM popular) - count(*) AS skipped_pairs, {_MEANS},
        (SELECT count(DISTINCT movieId) FROM popular WHERE pairId IN (SELECT pairId FROM metrics)) AS unique_items, round(avg(CASE WHEN recallA > 0 AND recallB > 0 THEN 1.0 ELSE 0 END), 6) AS two_sided_hit_rate FROM metrics""",
    "subgroup_summary": f"""SELECT similarityBand, count(*) AS pairs, {_MEANS} FROM metrics JOIN (SELECT pairId, CASE WHEN genreSimilarity <= 0 THEN 'high_conflict' WHEN genreSimilarity <= 0.2 THEN 'mixed' ELSE 'similar' END AS similarityBand FROM features) USING (pairId) GROUP BY similarityBand""",
    "target_coverage": "SELECT (SELECT count(*) FROM members JOIN targets USING (userId)) AS liked, (SELECT count(*) FROM relevant) AS remaining, (SELECT count(*) FROM (SELECT pairId FROM relevant GROUP BY pairId HAVING count(DISTINCT userId) = 2)) AS two_sided_pairs",
    "item_neighbours": "SELECT src, cand, round(similarity, 6) AS similarity FROM neighbours",
    "item_knn_scores": "SELECT userId, movieId, round(score, 5) AS score FROM (SELECT w.userId, cand AS movieId, sum(similarity) AS score FROM warm_edges w JOIN (SELECT *, count(*) OVER (PARTITION BY src) AS width FROM neighbours) ON src = movieId GROUP BY w.userId, cand)",
    "percentile_scores": "SELECT pairId, movieId, round(qA, 6) AS q_a, round(qB, 6) AS q_b FROM q",
    "group_linear": _top("0.35 * (qA + qB) / 2 + 0.65 * least(qA, qB)"),
    "group_average": _top("(qA + qB) / 2"),
    "group_least_misery": _top("least(qA, qB)"),
    "conflict_weights": """SELECT pairId, movieId, twentieths, rank, round(g, 11) AS group_score FROM (
        SELECT *, row_number() OVER (PARTITION BY pairId, twentieths ORDER BY round(g, 12) DESC, round(least(qA, qB), 12) DESC, round((qA + qB) / 2, 12) DESC, movieId) AS rank FROM (
            SELECT pairId, movieId, qA, qB, i AS twentieths, CASE WHEN i < 0 THEN sqrt(qA * qB) ELSE (1 - i / 20) * ((qA + qB) / 2) + i / 20 * least(qA, qB) END AS g FROM q CROSS JOIN (SELECT i - 1 AS i FROM range(22) t(i)))) WHERE rank <= 10""",
    "greedy_disjoint": _greedily(1),
    "capped_pairs": _greedily(2),
    "similarity_statistics": "SELECT count(genreSimilarity) AS count, round(avg(genreSimilarity), 6) AS mean, round(stddev_samp(genreSimilarity), 6) AS std, round(min(genreSimilarity), 6) AS min, "
    + ", ".join(f"round(quantile_cont(genreSimilarity, {q}), 6) AS q{int(100 * q)}" for q in (0.25, 0.5, 0.75))
    + ", round(max(genreSimilarity), 6) AS max FROM features",
    "subset_users": _SUBSET + "SELECT userId, focus FROM chosen",
    "subset_catalog": _SUBSET + "SELECT movieId, count(*) AS trainPositiveCount FROM warm_edges WHERE userId IN (SELECT userId FROM chosen) GROUP BY movieId",
    "group_nash": _top("sqrt(qA * qB)"),
    "edge_weights": "SELECT source, target, round(weight, 9) AS weight FROM weighted",
    "propagate_once": "SELECT node, round(value, 6) AS value FROM layer1",
    "propagate_mean": "SELECT node, round((a.value + coalesce(b.value, 0) + coalesce(c.value, 0)) / 3, 6) AS value FROM layer0 a LEFT JOIN layer1 b USING (node) LEFT JOIN layer2 c USING (node)",
    "node_degrees": "SELECT source AS node, count(*) AS degree FROM links GROUP BY source",
    "fold_in": """SELECT userId, pos - 1 AS pos, round(sum((rating - 3.5) * v) / sum(rating - 3.5), 6) AS value FROM split JOIN vec ON vec_id = movieId WHERE split = 'train' AND is_positive GROUP BY userId, pos""",
    "embedding_scores": "SELECT userId, movieId, round(list_dot_product(u, v), 5) + 0.0 AS score FROM folded CROSS JOIN items WHERE userId IN (SELECT userId FROM members)",
    "embedding_topk": """SELECT pairId, movieId, rank, round(s, 9) AS group_score FROM (SELECT *, row_number() OVER (PARTITION BY pairId ORDER BY round(s, 12) DESC, round(least(qA, qB), 12) DESC, round((qA + qB) / 2, 12) DESC, movieId) AS rank FROM (
        SELECT *, 0.35 * (qA + qB) / 2 + 0.65 * least(qA, qB) AS s FROM (SELECT pairId, movieId,
            (rank() OVER (PARTITION BY pairId ORDER BY a) + (count(*) OVER (PARTITION BY pairId, a) - 1) / 2) / count(*) OVER (PARTITION BY pairId) AS qA,
            (rank() OVER (PARTITION BY pairId ORDER BY b) + (count(*) OVER (PARTITION BY pairId, b) - 1) / 2) / count(*) OVER (PARTITION BY pairId) AS qB
        FROM (SELECT pairId, i.movieId, list_dot_product(x.u, v) AS a, list_dot_product(y.u, v) AS b FROM pairs JOIN folded x ON x.userId = userA JOIN folded y ON y.userId = userB CROSS JOIN items i
            WHERE NOT EXISTS (SELECT 1 FROM seen_pair s WHERE s.pairId = pairs.pairId AND s.movieId = i.movieId))))) WHERE rank <= 10""",
    "event_scores": "SELECT userId, movieId, round(list_dot_product(u, v), 5) + 0.0 AS score FROM targets JOIN folded USING (userId) JOIN items USING (movieId)",
    "ranking_loss": """SELECT round(avg(ln(1 + exp(list_dot_product(u, n.v) - list_dot_product(u, items.v)))), 6) AS loss FROM targets JOIN folded USING (userId) JOIN items USING (movieId)
        CROSS JOIN (SELECT v FROM catalog JOIN items USING (movieId) ORDER BY trainPositiveCount DESC, movieId LIMIT 1) n""",
    "graph_size": "SELECT count(DISTINCT userId) AS users, count(DISTINCT movieId) AS movies, count(DISTINCT userId) + count(DISTINCT movieId) AS nodes, count(*) AS positive_edges FROM warm_edges",
    "isolated_movies": "SELECT movieId AS node FROM movies WHERE movieId NOT IN (SELECT movieId FROM warm_edges)",
    "first_unliked": """SELECT userId, min(m.node) AS node FROM (SELECT DISTINCT userId FROM warm_edges) u CROSS JOIN (SELECT id, node FROM nodes WHERE kind = 1) m
        WHERE NOT EXISTS (SELECT 1 FROM warm_edges w WHERE w.userId = u.userId AND w.movieId = m.id) GROUP BY userId""",
    "focus_ratings": "SELECT userId, movieId, rating, timestamp FROM ratings WHERE timestamp < 946684800 AND userId IN (SELECT userId FROM evaluating)",
    "conflict_bands": "SELECT pairId, round(score, 6) AS conflict_score, conflictBand FROM banded",
    "conflict_summary": f"""SELECT 'popularity' AS method, conflictBand, count(*) AS pairs, round(avg((ndcgA + ndcgB) / 2), 6) AS mean_average_ndcg, round(avg(least(ndcgA, ndcgB)), 6) AS mean_minimum_ndcg, round(avg(least(recallA, recallB)), 6) AS mean_minimum_recall,
        round(avg(CASE WHEN recallA > 0 AND recallB > 0 THEN 1.0 ELSE 0 END), 6) AS two_sided_hit_rate, round(avg(CASE WHEN recallA > 0 OR recallB > 0 THEN 0.0 ELSE 1 END), 6) AS no_hit_rate FROM metrics JOIN banded USING (pairId) GROUP BY conflictBand""",
    "dissimilar_pairs": "SELECT userA, userB FROM known WHERE g <= (SELECT quantile_cont(g, 0.75) FROM known) AND r <= (SELECT quantile_cont(r, 0.75) FROM known)",
    "cold_start_list": """WITH own2 AS (SELECT movieId, rating FROM split WHERE split = 'train' AND userId = (SELECT min(userB) FROM pairs) AND movieId IN (SELECT movieId FROM catalog)),
        rated AS (SELECT 0 AS m, movieId, rating FROM own UNION ALL SELECT 1, movieId, rating FROM own2),
        pref AS (SELECT m, genre, sum(rating - 3) / (count(*) + 2) AS pref FROM (SELECT m, unnest(list_distinct(string_split(genres, '|'))) AS genre, rating FROM rated JOIN movies USING (movieId)) GROUP BY m, genre),
        pools AS (SELECT m, c.movieId, trainPositiveCount, genres, (rank() OVER (PARTITION BY m ORDER BY trainPositiveCount) + (count(*) OVER (PARTITION BY m, trainPositiveCount) - 1) / 2) / count(*) OVER (PARTITION BY m) AS popularity FROM (
            SELECT m, movieId, trainPositiveCount, genres FROM range(2) r(m) CROSS JOIN catalog JOIN movies USING (movieId) WHERE NOT EXISTS (SELECT 1 FROM rated t WHERE t.m = r.m AND t.movieId = catalog.movieId)
            QUALIFY row_number() OVER (PARTITION BY m ORDER BY trainPositiveCount DESC, movieId) <= 2000 + (SELECT count(DISTINCT movieId) FROM rated)) c),
        tastes AS (SELECT p.m, p.movieId, greatest(0, least(1, 0.5 + avg(coalesce(pref, 0)) / 2)) AS taste FROM (SELECT m, movieId, unnest(list_distinct(string_split(genres, '|'))) AS genre FROM pools) p LEFT JOIN pref ON pref.m = p.m AND pref.genre = p.genre GROUP BY p.m, p.movieId),
        scores AS (SELECT m, movieId, trainPositiveCount, 0.8 * conf * taste + (1 - 0.8 * conf) * popularity AS score FROM pools JOIN tastes USING (m, movieId) JOIN (SELECT m, count(*) / (count(*) + 5) AS conf FROM rated GROUP BY m) USING (m)),
        both_ AS (SELECT a.movieId, a.score AS sa, b.score AS sb FROM scores a JOIN scores b ON a.m = 0 AND b.m = 1 AND a.movieId = b.movieId WHERE a.movieId NOT IN (SELECT movieId FROM rated) ORDER BY a.trainPositiveCount DESC, a.movieId LIMIT 2000),
        qs AS (SELECT movieId, (rank() OVER (ORDER BY sa) + (count(*) OVER (PARTITION BY sa) - 1) / 2) / count(*) OVER () AS qA, (rank() OVER (ORDER BY sb) + (count(*) OVER (PARTITION BY sb) - 1) / 2) / count(*) OVER () AS qB FROM both_)
        SELECT movieId, rank, round(qA, 6) AS q_a, round(qB, 6) AS q_b FROM (SELECT *, row_number() OVER (ORDER BY round(0.35 * (qA + qB) / 2 + 0.65 * least(qA, qB), 12) DESC, round(least(qA, qB), 12) DESC, round((qA + qB) / 2, 12) DESC, movieId) AS rank FROM qs) WHERE rank <= 10""",
    "cold_start_scores": """SELECT movieId, round(popularity, 6) AS popularity, round(taste, 6) AS taste, round(0.8 * conf * taste + (1 - 0.8 * conf) * popularity, 6) AS score FROM (
        SELECT p.movieId, any_value(p.popularity) AS popularity, greatest(0, least(1, 0.5 + avg(coalesce(pref, 0)) / 2)) AS taste, any_value((SELECT count(*) / (count(*) + 5) FROM own)) AS conf FROM (
            SELECT *, (rank() OVER (ORDER BY trainPositiveCount) + (count(*) OVER (PARTITION BY trainPositiveCount) - 1) / 2) / count(*) OVER () AS popularity FROM pool) p
        CROSS JOIN unnest(list_distinct(string_split(p.genres, '|'))) g(genre) LEFT JOIN preference USING (genre) GROUP BY p.movieId)""",
    "rank_overlap": "SELECT count(*) AS comparedPairs, round(avg(CASE WHEN n = m AND same = n THEN 1.0 ELSE 0 END), 6) AS identical, round(avg(common / least(n, m)), 6) AS overlap, round(avg(same / least(n, m)), 6) AS same_position FROM ("
    "SELECT a.pairId, any_value(a.n) AS n, any_value(b.n) AS m, count(c.movieId) AS common, count(*) FILTER (c.rank = a.rank) AS same FROM (SELECT *, count(*) OVER (PARTITION BY pairId) AS n FROM (" + _top("sqrt(qA * qB)") + ")) a JOIN (SELECT pairId, count(*) AS n FROM popular GROUP BY pairId) b USING (pairId) LEFT JOIN popular c ON c.pairId = a.pairId AND c.movieId = a.movieId GROUP BY a.pairId)",
    "title_search": "SELECT movieId, title FROM movies WHERE contains(lower(title), 'widget') ORDER BY movieId LIMIT 50",
    "latest_events": "SELECT user_id AS userId, event_type AS movieId, arg_max(value, epoch_us(ts)) AS rating FROM events GROUP BY user_id, event_type",
    "genre_counts": "SELECT userId, genre, count(*) AS exposure, sum(liked)::BIGINT AS likes FROM rated_genres GROUP BY userId, genre",
    "item_degrees": "SELECT movieId, d AS degree FROM degrees",
    "pair_candidate_counts": "SELECT pairId, count(*) AS candidates FROM candidates GROUP BY pairId",
    "catalog_digest": "SELECT count(*) AS rows, sum(trainPositiveCount)::BIGINT AS likes FROM catalog",
    "preview_images": "SELECT page_id, nullif(regexp_extract(html, '<meta[^>]*property=\"og:image\"[^>]*content=\"([^\"]*)\"', 1), '') AS image FROM pages",
}


def oracle_sql() -> dict[str, str]:
    return {n: _WITH + (s if not s.startswith("WITH ") else "SELECT * FROM (" + s + ")") for n, s in _SELECT.items()}
