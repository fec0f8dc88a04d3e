"""DuckDB statements that state the same results as the registered queries."""

from __future__ import annotations

_TREE = """
tips AS (SELECT n_name AS name, n_nationkey AS k, n_regionkey AS g, r_name AS gname, (0.5 + (n_nationkey % 8) / 8.0)::DOUBLE AS len, (1 + n_regionkey / 8.0)::DOUBLE AS glen FROM nation JOIN region ON n_regionkey = r_regionkey),
tips2 AS (SELECT n_name AS name, n_nationkey AS k, n_nationkey // 5 AS g, (0.5 + (n_nationkey % 8) / 8.0)::DOUBLE AS len, (1 + (n_nationkey // 5) / 8.0)::DOUBLE AS glen FROM nation),
nodes AS (
  SELECT name, 'tip' AS kind, g, k, len AS length, glen + len AS depth_len, 2 AS depth FROM tips
  UNION ALL SELECT DISTINCT gname, 'group', g, -1, glen, glen, 1 FROM tips
  UNION ALL SELECT NULL, 'root', -1, -1, NULL, 0.0, 0),
numbered AS (SELECT *, (row_number() OVER (ORDER BY g, k) - 1)::INTEGER AS node_id FROM nodes),
indexed AS (
  SELECT n.*, (SELECT count(*) FROM numbered t WHERE t.kind = 'tip' AND t.node_id < n.node_id)::INTEGER AS leaf_lo,
    (CASE n.kind WHEN 'tip' THEN 1 WHEN 'group' THEN (SELECT count(*) FROM tips t WHERE t.g = n.g) ELSE (SELECT count(*) FROM tips) END)::INTEGER AS n_tips,
    (CASE n.kind WHEN 'tip' THEN (SELECT m.node_id FROM numbered m WHERE m.kind = 'group' AND m.g = n.g) WHEN 'group' THEN 0 END)::INTEGER AS parent_id FROM numbered n),
paths AS (SELECT t.name AS taxon, n.node_id AS edge_id, n.length FROM tips t JOIN numbered n ON n.kind = 'tip' AND n.name = t.name UNION ALL SELECT t.name, n.node_id, n.length FROM tips t JOIN numbered n ON n.kind = 'group' AND n.g = t.g),
dist AS (SELECT a.name AS x, b.name AS y, a.len + b.len + CASE WHEN a.g = b.g THEN 0 ELSE a.glen + b.glen END AS d FROM tips a JOIN tips b ON a.name < b.name),
dist2 AS (SELECT a.name AS x, b.name AS y, a.len + b.len + CASE WHEN a.g = b.g THEN 0 ELSE a.glen + b.glen END AS d FROM tips2 a JOIN tips2 b ON a.name < b.name),
orders_of AS (SELECT n_name AS nation, c_mktsegment, o_orderpriority, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
com AS (SELECT c_mktsegment || '|' || o_orderpriority AS sample, nation AS taxon, count(*)::DOUBLE AS abundance FROM orders_of GROUP BY ALL),
com_month AS (SELECT c_mktsegment || '|' || strftime(o_orderdate, '%Y-%m') AS sample, nation AS taxon, count(*)::DOUBLE AS abundance FROM orders_of GROUP BY ALL),
w AS (SELECT sample, taxon, abundance / sum(abundance) OVER (PARTITION BY sample) AS w FROM com),
w_month AS (SELECT sample, taxon, abundance / sum(abundance) OVER (PARTITION BY sample) AS w FROM com_month),
both_ways AS (SELECT x, y, d FROM dist UNION ALL SELECT y, x, d FROM dist)
"""


def _tree(body: str) -> str:
    return f"WITH {_TREE}, {body.lstrip()}" if body.lstrip()[:6].upper() != "SELECT" else f"WITH {_TREE} {body}"


_SPLITS = """
sp AS (SELECT 'geo' AS tree_id, g, list(name ORDER BY name) AS side, any_value(glen) AS length FROM tips GROUP BY g UNION ALL SELECT 'geo2', g, list(name ORDER BY name), any_value(glen) FROM tips2 GROUP BY g),
named AS (SELECT list(name ORDER BY name) AS names FROM tips),
split AS (SELECT tree_id, g, length, CASE WHEN list_contains(side, names[1]) THEN list_filter(names, lambda x: NOT list_contains(side, x)) ELSE side END AS side FROM sp, named)
"""

_ALN = """
orders_of AS (SELECT n_name AS nation, c_mktsegment, o_orderpriority, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
per AS (SELECT nation, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders_of GROUP BY ALL),
months AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS col FROM (SELECT DISTINCT month FROM per)),
names AS (SELECT nation AS name, row_number() OVER (ORDER BY nation) - 1 AS row_ord FROM (SELECT DISTINCT nation FROM per)),
sites AS (SELECT r.name, r.row_ord, m.col, CASE WHEN p.n IS NULL THEN '-' ELSE substr('ACGT', (p.n % 4)::INTEGER + 1, 1) END AS ch FROM names r CROSS JOIN months m LEFT JOIN per p ON p.nation = r.name AND p.month = m.month),
aln AS (SELECT name, row_ord, string_agg(ch, '' ORDER BY col) AS seq FROM sites GROUP BY ALL),
counts AS (SELECT a.name AS x, b.name AS y, count(*) FILTER (a.ch <> '-' AND b.ch <> '-') AS n, count(*) FILTER (a.ch <> '-' AND a.ch = b.ch) AS same,
  count(*) FILTER (a.ch <> b.ch AND ((a.ch IN ('A','G') AND b.ch IN ('A','G')) OR (a.ch IN ('C','T') AND b.ch IN ('C','T')))) AS ts
  FROM sites a JOIN sites b ON a.col = b.col AND a.row_ord < b.row_ord GROUP BY a.name, b.name),
pq AS (SELECT x, y, n, 1 - same / n AS p, ts / n AS ts, 1 - same / n - ts / n AS tv FROM counts),
stats AS (SELECT col, avg((ch = '-')::INTEGER) AS gap_fraction FROM sites GROUP BY col),
kept AS (SELECT col, coalesce(max(c) FILTER (ch <> '-') / sum(c) FILTER (ch <> '-'), 0) AS conservation FROM (SELECT col, ch, count(*) AS c FROM sites GROUP BY ALL) GROUP BY col)
"""


def _aln(body: str) -> str:
    return f"WITH {_ALN}, {body.lstrip()}" if body.lstrip()[:6].upper() != "SELECT" else f"WITH {_ALN} {body}"


def _distance(value: str) -> str:
    return _aln(f"SELECT x, y, round(CASE WHEN n = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE {value} END, 9) AS d FROM pq")


_BIALLELIC = """
known AS (SELECT col, ch, count(*) AS n, min(row_ord) AS first FROM sites WHERE ch <> '-' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, first) AS k FROM known),
two AS (SELECT col, max(ch) FILTER (k = 1) AS c0, max(ch) FILTER (k = 2) AS c1, max(n) FILTER (k = 2) AS n1 FROM ranked GROUP BY col),
info AS (SELECT *, row_number() OVER (ORDER BY col) - 1 AS pos FROM two WHERE n1 >= 2),
al AS (SELECT i.col, i.pos, s.row_ord, CASE s.ch WHEN c0 THEN 0 WHEN c1 THEN 1 END AS allele FROM sites s JOIN info i USING (col))
"""

_PERMS = """
items AS (SELECT name AS item FROM tips),
spread AS (SELECT item, p::INTEGER AS perm_id, md5('{seed}|' || p || '|' || item) AS said FROM items, range(1, {n} + 1) t(p)),
placed AS (SELECT *, row_number() OVER (PARTITION BY perm_id ORDER BY item) AS i, row_number() OVER (PARTITION BY perm_id ORDER BY said, item) AS j FROM spread),
moves AS (SELECT a.perm_id, a.item, b.item AS other FROM placed a JOIN placed b ON a.perm_id = b.perm_id AND a.i = b.j UNION ALL SELECT 0, item, item FROM items),
pw AS (SELECT m.perm_id, sample, m.other AS taxon, w FROM w JOIN moves m ON m.item = w.taxon)
"""

_SES = """
nul AS (SELECT {keys}, avg(v) AS null_mean, stddev_samp(v) AS null_sd, count(v) AS n FROM val WHERE perm_id > 0 GROUP BY {keys}),
seen AS (SELECT o.*, null_mean, null_sd, n FROM (SELECT {keys}, v AS observed FROM val WHERE perm_id = 0) o JOIN nul USING ({keys})),
more AS (SELECT {keys}, count(*) FILTER (abs(v - null_mean) >= abs(observed - null_mean) - 1e-12) AS extreme FROM val JOIN seen USING ({keys}) WHERE perm_id > 0 GROUP BY {keys})
SELECT {keys}, round(observed, 9) AS observed, round(null_mean, 9) AS null_mean, round(null_sd, 9) AS null_sd,
  round(CASE WHEN null_sd > 1e-12 THEN {sign} * (observed - null_mean) / null_sd END, 9) AS {name}, round((extreme + 1) / (n + 1), 9) AS p FROM seen JOIN more USING ({keys})
"""


def _ses(value: str, keys: str, sign: int, name: str, n: int) -> str:
    return _tree(_PERMS.format(seed=7, n=n) + ", " + value + ", " + _SES.format(keys=keys, sign=sign, name=name))


def _unifrac(com: str, value: str) -> str:
    return _tree(f"""
f AS (SELECT sample, edge_id, any_value(length) AS length, sum(abundance) / any_value(whole) AS f FROM (SELECT *, sum(abundance) OVER (PARTITION BY sample) AS whole FROM {com}) c JOIN paths USING (taxon) GROUP BY sample, edge_id),
s AS (SELECT DISTINCT sample FROM f), e AS (SELECT DISTINCT edge_id, length FROM f),
x AS (SELECT a.sample AS a, b.sample AS b, e.length, coalesce(fa.f, 0) AS fa, coalesce(fb.f, 0) AS fb FROM s a JOIN s b ON a.sample < b.sample CROSS JOIN e LEFT JOIN f fa ON fa.sample = a.sample AND fa.edge_id = e.edge_id LEFT JOIN f fb ON fb.sample = b.sample AND fb.edge_id = e.edge_id)
SELECT a, b, round({value}, 9) AS unifrac FROM x GROUP BY a, b""")


_WEIGHTED = "sum(length * abs(fa - fb)) / sum(length * (fa + fb))"
_GRID = "coalesce(sum(length) FILTER (fa > 0 AND fb = 0), 0) + coalesce(sum(length) FILTER (fa = 0 AND fb > 0), 0)"
_MONTHS_EXPR = """
ex AS (SELECT 'label' || label AS cell, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
e AS (SELECT cell, i, round(avg(v), 6) AS value FROM ex GROUP BY ALL),
p AS (SELECT a.cell AS x, b.cell AS y, a.value AS u, b.value AS v FROM e a JOIN e b ON a.i = b.i AND a.cell < b.cell)
"""
_MARKERS = """
orders_of AS (SELECT n_name AS nation, o_orderpriority AS marker, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
per AS (SELECT marker, nation, y, count(*) AS n FROM orders_of GROUP BY ALL), years AS (SELECT DISTINCT y FROM per),
grid AS (SELECT m.marker, m.nation, y.y, CASE WHEN p.n IS NULL THEN '-' ELSE substr('ACGT', (p.n % 4)::INTEGER + 1, 1) END AS c FROM (SELECT DISTINCT marker, nation FROM per) m CROSS JOIN years y LEFT JOIN per p ON p.marker = m.marker AND p.nation = m.nation AND p.y = y.y),
mk AS (SELECT marker, substr(marker, 1, 1)::INTEGER AS marker_ord, nation AS name, string_agg(c, '' ORDER BY y) AS seq FROM grid GROUP BY marker, nation)
"""
_CHARS = """
orders_of AS (SELECT n_name AS nation, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
top AS (SELECT nation, 'segment' AS character, c_mktsegment AS state, count(*) AS n FROM orders_of GROUP BY ALL UNION ALL SELECT nation, 'priority', o_orderpriority, count(*) FROM orders_of GROUP BY ALL),
ch AS (SELECT nation AS name, character, state FROM top QUALIFY row_number() OVER (PARTITION BY nation, character ORDER BY n DESC, state DESC) = 1)
"""

#: Nodes where a rectangular layout puts them.
_PLACED = "r AS (SELECT node_id, parent_id, depth_len AS x, (leaf_lo + leaf_lo + n_tips - 1) / 2.0::DOUBLE AS y FROM indexed) "
_SEGMENTS = "seg AS (SELECT nation, v FROM (SELECT nation, c_mktsegment AS v, count(*) AS n FROM orders_of GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, v DESC) = 1), ranked AS (SELECT nation, dense_rank() OVER (ORDER BY v) AS k FROM seg) "
#: Clades of two trees with each taxon left out in turn (no clade is as large as half the tips, so a split is its clade).
_ROGUE = """sides AS (SELECT 'a' AS t, g, name FROM tips UNION ALL SELECT 'b', g, name FROM tips2), outs AS (SELECT '' AS wo UNION ALL SELECT name FROM tips),
clades AS (SELECT DISTINCT t, wo, k FROM (SELECT t, g, wo, string_agg(name, '|' ORDER BY name) AS k FROM sides, outs WHERE name <> wo GROUP BY ALL HAVING count(*) >= 2)),
shared AS (SELECT wo, k, count(*) AS c FROM clades GROUP BY ALL),
rf AS (SELECT wo, count(*) FILTER (c = 1) / (2.0 * ((SELECT count(*) FROM tips) - (wo <> '')::INTEGER - 3))::DOUBLE AS rf FROM shared GROUP BY wo),
best AS (SELECT wo, rf FROM rf WHERE wo <> '' ORDER BY rf, wo LIMIT 1) """

SQL: dict[str, str] = {
    "tree_nodes_index": _tree("""SELECT node_id, parent_id, (CASE kind WHEN 'tip' THEN row_number() OVER (PARTITION BY kind, g ORDER BY k) - 1 WHEN 'group' THEN row_number() OVER (PARTITION BY kind ORDER BY g) - 1 ELSE 0 END)::INTEGER AS child_ord,
      name, length, (CASE kind WHEN 'tip' THEN node_id WHEN 'group' THEN node_id + n_tips ELSE (SELECT max(node_id) FROM numbered) END)::INTEGER AS pre_end,
      (CASE kind WHEN 'tip' THEN node_id - 2 WHEN 'group' THEN node_id + n_tips - 1 ELSE (SELECT max(node_id) FROM numbered) END)::INTEGER AS post, depth AS depth_edges, depth_len, kind = 'tip' AS is_leaf,
      CASE WHEN kind = 'tip' THEN leaf_lo END AS tip_ord, leaf_lo, leaf_lo + n_tips - 1 AS leaf_hi, n_tips FROM indexed"""),
    "tree_newick": _tree("SELECT node_id, name, length FROM numbered"),
    "tree_tip_paths": _tree("SELECT taxon, edge_id, length FROM paths"),
    "tree_join_metadata": _tree("SELECT name, balance FROM (SELECT name FROM numbered WHERE name IS NOT NULL) LEFT JOIN (SELECT n_name AS name, sum(c_acctbal::DECIMAL(15,2))::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) USING (name)"),
    "tree_search_nodes": _tree("SELECT name, n_tips FROM indexed WHERE kind = 'group'"),
    "tree_mrca": _tree("SELECT 'within' AS q, name, n_tips FROM indexed WHERE kind = 'group' AND g = (SELECT g FROM tips WHERE name = 'NATION_3') UNION ALL SELECT 'across', 'root', n_tips FROM indexed WHERE kind = 'root'"),
    "tree_group_clade": _tree('SELECT name, CASE gname WHEN \'ASIA\' THEN \'east\' WHEN \'AMERICA\' THEN \'west\' ELSE \'rest\' END AS "group" FROM tips'),
    "tree_scale_clade": _tree("SELECT node_id, CASE WHEN kind = 'tip' AND g = 3 THEN length * 2 ELSE length END AS length, CASE WHEN kind = 'tip' AND g = 3 THEN depth_len + length ELSE depth_len END AS depth_len FROM numbered"),
    "tree_collapse_clade": _tree("SELECT 'AFRICA' AS name, count(*)::INTEGER AS n, min(len) AS near, max(len) AS far FROM tips WHERE gname = 'AFRICA'"),
    "tree_prune": _tree("SELECT name, CASE WHEN gname = 'ASIA' THEN len + glen ELSE len END AS length, len + glen AS depth_len FROM tips WHERE name IN ('NATION_3', 'NATION_8', 'NATION_2')"),
    "tree_cut_height": _tree("SELECT name AS taxon, g AS cluster FROM tips"),
    "tree_cut_k": _tree("SELECT name AS taxon, g AS cluster FROM tips"),
    "tree_ladderize": _tree("SELECT name, leaf_lo AS tip_ord FROM indexed WHERE kind = 'tip'"),
    "tree_support_collapse": "SELECT * FROM (VALUES ('a', 2.0::DOUBLE, 2), ('b', 2.0, 2), ('c', 1.0, 2), ('d', 3.0, 1), ('e', 3.0, 1)) t(name, length, depth_edges)",
    "total_branch_length": _tree("SELECT 'geo' AS tree_id, sum(coalesce(length, 0)) AS total FROM numbered"),
    "patristic": _tree("SELECT x, y, d FROM dist"),
    "topological": _tree("SELECT a.name AS x, b.name AS y, CASE WHEN a.g = b.g THEN 2.0 ELSE 4.0 END::DOUBLE AS d FROM tips a JOIN tips b ON a.name < b.name"),
    "phylo_vcv": _tree("SELECT a.name AS x, b.name AS y, CASE WHEN a.name = b.name THEN a.glen + a.len WHEN a.g = b.g THEN a.glen ELSE 0 END AS v FROM tips a JOIN tips b ON a.name <= b.name"),
    "faiths_pd_table": _tree("SELECT sample, sum(length) AS pd FROM (SELECT DISTINCT sample, edge_id, length FROM com_month JOIN paths USING (taxon)) GROUP BY sample"),
    "unifrac_unweighted": _unifrac("com", f"({_GRID}) / sum(length) FILTER (fa > 0 OR fb > 0)"),
    "unifrac_weighted": _unifrac("com_month", _WEIGHTED),
    "unifrac_weighted_raw": _unifrac("com", "sum(length * abs(fa - fb))"),
    "mpd": _tree("SELECT a.sample, round(avg(d), 9) AS mpd FROM w_month a JOIN w_month b ON a.sample = b.sample AND a.taxon < b.taxon JOIN dist ON x = a.taxon AND y = b.taxon GROUP BY a.sample"),
    "mpd_weighted": _tree("SELECT a.sample, round(sum(d * a.w * b.w) / sum(a.w * b.w), 9) AS mpd FROM w a JOIN w b ON a.sample = b.sample AND a.taxon < b.taxon JOIN dist ON x = a.taxon AND y = b.taxon GROUP BY a.sample"),
    "mntd": _tree("SELECT sample, round(avg(d), 9) AS mntd FROM (SELECT a.sample, a.taxon, min(d) AS d FROM w_month a JOIN w_month b ON a.sample = b.sample AND a.taxon <> b.taxon JOIN both_ways ON x = a.taxon AND y = b.taxon GROUP BY ALL) GROUP BY sample"),
    "mntd_weighted": _tree("SELECT sample, round(sum(d * w) / sum(w), 9) AS mntd FROM (SELECT a.sample, a.taxon, a.w, min(d) AS d FROM w a JOIN w b ON a.sample = b.sample AND a.taxon <> b.taxon JOIN both_ways ON x = a.taxon AND y = b.taxon GROUP BY ALL) GROUP BY sample"),
    "beta_mntd": _tree("near AS (SELECT a.sample AS s, b.sample AS t, a.taxon, a.w, min(CASE WHEN a.taxon = b.taxon THEN 0 ELSE d END) AS d FROM w a JOIN w b ON a.sample <> b.sample LEFT JOIN both_ways ON x = a.taxon AND y = b.taxon GROUP BY ALL), m AS (SELECT s, t, sum(d * w) / sum(w) AS m FROM near GROUP BY ALL) SELECT least(s, t) AS a, greatest(s, t) AS b, round(avg(m), 9) AS beta_mntd FROM m GROUP BY ALL"),
    "ses_mpd_nri": _ses("val AS (SELECT a.perm_id, a.sample, sum(d * a.w * b.w) / sum(a.w * b.w) AS v FROM pw a JOIN pw b ON a.perm_id = b.perm_id AND a.sample = b.sample AND a.taxon < b.taxon JOIN dist ON x = a.taxon AND y = b.taxon GROUP BY ALL)", "sample", -1, "nri", 29),
    "ses_mntd_nti": _ses("val AS (SELECT perm_id, sample, sum(d * w) / sum(w) AS v FROM (SELECT a.perm_id, a.sample, a.taxon, a.w, min(d) AS d FROM pw a JOIN pw b ON a.perm_id = b.perm_id AND a.sample = b.sample AND a.taxon <> b.taxon JOIN both_ways ON x = a.taxon AND y = b.taxon GROUP BY ALL) GROUP BY ALL)", "sample", -1, "nti", 29),
    "beta_nti": _ses("near AS (SELECT a.perm_id, a.sample AS s, b.sample AS t, a.taxon, a.w, min(CASE WHEN a.taxon = b.taxon THEN 0 ELSE d END) AS d FROM pw a JOIN pw b ON a.perm_id = b.perm_id AND a.sample <> b.sample LEFT JOIN both_ways ON x = a.taxon AND y = b.taxon GROUP BY ALL), m AS (SELECT perm_id, s, t, sum(d * w) / sum(w) AS m FROM near GROUP BY ALL), val AS (SELECT perm_id, least(s, t) AS a, greatest(s, t) AS b, avg(m) AS v FROM m GROUP BY ALL)", "a, b", 1, "beta_nti", 9),
    "mantel_pearson": _tree("""items AS (SELECT name AS item FROM tips), spread AS (SELECT item, p::INTEGER AS perm_id, md5('3|' || p || '|' || item) AS said FROM items, range(1, 100) t(p)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY perm_id ORDER BY item) AS i, row_number() OVER (PARTITION BY perm_id ORDER BY said, item) AS j FROM spread),
      moves AS (SELECT a.perm_id, a.item, b.item AS other FROM placed a JOIN placed b ON a.perm_id = b.perm_id AND a.i = b.j UNION ALL SELECT 0, item, item FROM items),
      moved AS (SELECT p.perm_id, least(p.other, q.other) AS x, greatest(p.other, q.other) AS y, d AS da FROM dist JOIN moves p ON p.item = x JOIN moves q ON q.item = y AND q.perm_id = p.perm_id),
      r AS (SELECT perm_id, corr(da, dist2.d) AS r, count(*) AS n FROM moved JOIN dist2 USING (x, y) GROUP BY perm_id), o AS (SELECT r AS r0, n FROM r WHERE perm_id = 0)
      SELECT round(any_value(r0), 9) AS r, round((count(*) FILTER (abs(r) >= abs(r0) - 1e-12) + 1) / (count(*) + 1), 9) AS p, any_value(o.n) AS n_pairs FROM r, o WHERE perm_id > 0"""),
    "tree_splits": _tree(_SPLITS + "SELECT array_to_string(side, '|') AS side, len(side)::INTEGER AS size, length FROM split WHERE tree_id = 'geo'"),
    "rf_distance": _tree(_SPLITS + "SELECT 'geo' AS a, 'geo2' AS b, count(*) AS rf FROM (SELECT side FROM split GROUP BY side HAVING count(DISTINCT tree_id) = 1)"),
    "rf_normalized": _tree(_SPLITS + "SELECT 'geo' AS a, 'geo2' AS b, round(count(*) / (2.0 * ((SELECT count(*) FROM tips) - 3)), 9) AS rf FROM (SELECT side FROM split GROUP BY side HAVING count(DISTINCT tree_id) = 1)"),
    "split_frequencies": _tree(_SPLITS + "SELECT array_to_string(side, '|') AS side, len(side)::INTEGER AS size, count(DISTINCT tree_id) AS n_trees, count(DISTINCT tree_id) / 2.0::DOUBLE AS frequency FROM split GROUP BY ALL"),
    "split_conflicts": _tree(_SPLITS + ", u AS (SELECT DISTINCT side FROM split) SELECT count(*) AS n FROM u a JOIN u b ON array_to_string(a.side, '|') < array_to_string(b.side, '|') WHERE len(list_intersect(a.side, b.side)) BETWEEN 1 AND least(len(a.side), len(b.side)) - 1"),
    "crossing_number": _tree("o AS (SELECT t.name, row_number() OVER (ORDER BY t.g, t.k) AS l, row_number() OVER (ORDER BY u.g, u.k) AS r FROM tips t JOIN tips2 u USING (name)) SELECT count(*) AS crossings FROM o a JOIN o b ON a.l < b.l AND a.r > b.r"),
    "discordant_links": _tree("o AS (SELECT t.name, row_number() OVER (ORDER BY t.g, t.k) AS l, row_number() OVER (ORDER BY u.g, u.k) AS r FROM tips t JOIN tips2 u USING (name)) SELECT a.name, count(b.name) AS crossings FROM o a LEFT JOIN o b ON (a.l < b.l AND a.r > b.r) OR (a.l > b.l AND a.r < b.r) GROUP BY a.name"),
    "taxon_displacement": _tree("""nb AS (SELECT a.name AS x, b.name AS y, 'a' AS t FROM tips a JOIN tips b ON a.g = b.g AND a.name <> b.name UNION ALL SELECT a.name, b.name, 'b' FROM tips2 a JOIN tips2 b ON a.g = b.g AND a.name <> b.name)
      SELECT 'geo' AS a, 'geo2' AS b, x AS taxon, round(1 - count(*) FILTER (c = 2) / count(*), 9) AS displacement FROM (SELECT x, y, count(*) AS c FROM nb GROUP BY ALL) GROUP BY x"""),
    "astrid_distances": _tree("SELECT a.name AS x, b.name AS y, (CASE WHEN a.g = b.g THEN 2.0 ELSE 4.0 END + CASE WHEN c.g = e.g THEN 2.0 ELSE 4.0 END)::DOUBLE / 2 AS d, 2::BIGINT AS n_trees FROM tips a JOIN tips b ON a.name < b.name JOIN tips2 c ON c.name = a.name JOIN tips2 e ON e.name = b.name"),
    "aln_column_statistics": _aln("SELECT col, round(gap_fraction, 9) AS gap_fraction, round(conservation, 9) AS conservation FROM stats JOIN kept USING (col)"),
    "aln_trim": _aln("SELECT name, string_agg(ch, '' ORDER BY col) AS seq FROM sites JOIN stats USING (col) JOIN kept USING (col) WHERE gap_fraction <= 0.3 AND conservation >= 0.3 GROUP BY name"),
    "aln_trim_terminal": _aln("b AS (SELECT min(col) AS lo, max(col) AS hi FROM stats WHERE gap_fraction <= 0.2) SELECT name, string_agg(ch, '' ORDER BY col) AS seq FROM sites, b WHERE col BETWEEN lo AND hi GROUP BY name"),
    "aln_site_patterns": _aln("SELECT pattern, count(*) AS weight, min(col) AS first_col FROM (SELECT col, string_agg(ch, '' ORDER BY row_ord) AS pattern FROM sites GROUP BY col) GROUP BY pattern"),
    "distance_raw": _distance("p"),
    "distance_jc69": _distance("CASE WHEN p >= 0.74 THEN 3.0 ELSE -0.75 * ln(1 - 4 * p / 3) END"),
    "distance_k2p": _distance("CASE WHEN 1 - 2 * ts - tv > 0 AND 1 - 2 * tv > 0 THEN -0.5 * ln((1 - 2 * ts - tv) * sqrt(1 - 2 * tv)) ELSE 3.0 END"),
    "distance_poisson": _distance("CASE WHEN p >= 0.9999 THEN 5.0 ELSE -ln(1 - p) END"),
    "kmer_distance": _aln("""bare AS (SELECT name, row_ord, replace(seq, '-', '') AS s FROM aln), g AS (SELECT name, substr(s, i::INTEGER, 3) AS g, count(*) AS c FROM bare, range(1, 10000) t(i) WHERE i <= length(s) - 2 GROUP BY ALL), t AS (SELECT name, sum(c) AS t FROM g GROUP BY name),
      bth AS (SELECT a.name AS x, b.name AS y, sum(least(a.c, b.c)) AS n FROM g a JOIN g b ON a.g = b.g GROUP BY ALL)
      SELECT a.name AS x, b.name AS y, round(coalesce(1 - coalesce(n, 0) / nullif(least(coalesce(ta.t, 0), coalesce(tb.t, 0)), 0), 1.0), 9)::DOUBLE AS d FROM bare a JOIN bare b ON a.row_ord < b.row_ord LEFT JOIN t ta ON ta.name = a.name LEFT JOIN t tb ON tb.name = b.name LEFT JOIN bth ON x = a.name AND y = b.name"""),
    "identity_network": _aln("SELECT x, y, round(1 - p, 9) AS w FROM pq WHERE n > 0 AND 1 - p > 0.3"),
    "network_edges": _aln("SELECT x, y, round(1 - p, 9) AS w FROM pq WHERE n > 0 AND 1 - p > 0.3"),
    "connected_components": "WITH RECURSIVE " + _ALN.lstrip() + """, edges AS (SELECT x, y FROM pq WHERE n > 0 AND 1 - p > 0.38 UNION ALL SELECT y, x FROM pq WHERE n > 0 AND 1 - p > 0.38),
      reach AS (SELECT name AS x, name AS y FROM names UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x), c AS (SELECT x AS name, min(y) AS component FROM reach GROUP BY x) SELECT name, component, count(*) OVER (PARTITION BY component) AS size FROM c""",
    "parsimony_bounds": _aln("SELECT sum(d - 1)::BIGINT AS least, sum(n - m)::BIGINT AS most FROM (SELECT col, count(*) AS d, sum(c) AS n, max(c) AS m FROM (SELECT col, ch, count(*) AS c FROM sites WHERE ch <> '-' GROUP BY ALL) GROUP BY col)"),
    "concatenate_supermatrix": f"WITH {_MARKERS}, wd AS (SELECT marker, marker_ord, max(length(seq)) AS w FROM mk GROUP BY ALL), nm AS (SELECT DISTINCT name FROM mk) SELECT nm.name, string_agg(coalesce(seq, repeat('-', w)), '' ORDER BY wd.marker_ord) AS seq, count(seq) AS n_markers, round(avg((seq IS NOT NULL)::INTEGER), 9) AS occupancy FROM nm CROSS JOIN wd LEFT JOIN mk ON mk.name = nm.name AND mk.marker = wd.marker GROUP BY nm.name",
    "marker_partitions": f"WITH {_MARKERS}, wd AS (SELECT marker, marker_ord, max(length(seq)) AS w, count(*) AS n_taxa FROM mk GROUP BY ALL) SELECT marker, (sum(w) OVER (ORDER BY marker_ord) - w)::BIGINT AS start, (sum(w) OVER (ORDER BY marker_ord))::BIGINT AS \"end\", n_taxa FROM wd",
    "split_domains": _aln("res AS (SELECT col, row_number() OVER (ORDER BY col) AS r FROM sites WHERE name = 'NATION_3' AND ch <> '-'), b AS (SELECT d.domain, min(col) AS lo, max(col) AS hi FROM res JOIN (VALUES ('early', 1, 6), ('late', 7, 20)) d(domain, a, z) ON r BETWEEN a AND z GROUP BY d.domain) SELECT domain, name, string_agg(ch, '' ORDER BY col) AS seq FROM sites JOIN b ON col BETWEEN lo AND hi GROUP BY ALL"),
    "biallelic_recode": _aln(_BIALLELIC + "SELECT col, pos, row_ord, allele::BIGINT AS allele FROM al"),
    "four_gamete_pairs": _aln(_BIALLELIC + "SELECT a.pos AS pos_a, b.pos AS pos_b, count(*) >= 2 AS scored, bit_or(1 << (2 * a.allele + b.allele)) = 15 AS incompatible FROM al a JOIN al b ON a.row_ord = b.row_ord AND b.pos - a.pos BETWEEN 1 AND 5 WHERE a.allele IS NOT NULL AND b.allele IS NOT NULL GROUP BY ALL"),
    "codon_f3x4": _aln("""c AS (SELECT substr(seq, (3 * i + 1)::INTEGER, 3) AS codon FROM aln, range(0, 1000) t(i) WHERE 3 * i + 3 <= length(seq)), sense AS (SELECT codon FROM c WHERE NOT contains(codon, '-') AND codon NOT IN ('TAA', 'TAG', 'TGA')),
      f0 AS (SELECT k, substr(codon, k::INTEGER, 1) AS b, count(*) AS n FROM sense, range(1, 4) t(k) GROUP BY ALL), f AS (SELECT k, b, n / sum(n) OVER (PARTITION BY k) AS f FROM f0),
      x AS (SELECT a.b || b.b || c.b AS codon, a.f * b.f * c.f AS p FROM f a, f b, f c WHERE a.k = 1 AND b.k = 2 AND c.k = 3) SELECT codon, round(p / sum(p) OVER (), 9) AS pi FROM x WHERE codon NOT IN ('TAA', 'TAG', 'TGA')"""),
    "character_matrix": f"WITH {_CHARS} SELECT name, character, state, dense_rank() OVER (PARTITION BY character ORDER BY state) - 1 AS code, (dense_rank() OVER (PARTITION BY character ORDER BY state) - 1)::VARCHAR AS symbol FROM ch",
    "mutation_matrix": f"WITH {_CHARS}, d AS (SELECT character, state, dense_rank() OVER (PARTITION BY character ORDER BY state) AS code FROM (SELECT DISTINCT character, state FROM ch WHERE state <> 'BUILDING')) SELECT name, character, state, coalesce(code, 0) AS code FROM ch LEFT JOIN d USING (character, state)",
    "allele_table": """WITH e AS (SELECT user_id::VARCHAR AS name, event_type AS target, min((props->>'$.k')::INTEGER) AS a, max((props->>'$.k')::INTEGER) AS b FROM events GROUP BY ALL),
      l AS (SELECT name, target || '|r1' AS character, a AS k FROM e UNION ALL SELECT name, target || '|r2', b FROM e), grid AS (SELECT n.name, c.character, l.k, l.name IS NOT NULL AS there FROM (SELECT DISTINCT name FROM l) n CROSS JOIN (SELECT DISTINCT character FROM l) c LEFT JOIN l ON l.name = n.name AND l.character = c.character),
      s AS (SELECT name, character, CASE WHEN k IS NULL THEN NULL WHEN k % 4 = 0 THEN 'None' ELSE k || 'D' END AS state FROM grid), d AS (SELECT character, state, dense_rank() OVER (PARTITION BY character ORDER BY state) AS code FROM (SELECT DISTINCT character, state FROM s WHERE state <> 'None'))
      SELECT name, character, state, CASE WHEN state IS NULL THEN -1 WHEN state = 'None' THEN 0 ELSE code END AS code FROM s LEFT JOIN d USING (character, state)""",
    "expression_euclidean": f"WITH {_MONTHS_EXPR} SELECT x, y, round(sqrt(sum((u - v) * (u - v))), 5) AS d FROM p GROUP BY ALL",
    "expression_correlation": f"WITH {_MONTHS_EXPR} SELECT x, y, round(1 - corr(u, v), 5) AS d FROM p GROUP BY ALL",
    "expression_cosine": f"WITH {_MONTHS_EXPR} SELECT x, y, round(1 - sum(u * v) / sqrt(sum(u * u) * sum(v * v)), 5) AS d FROM p GROUP BY ALL",
    "cluster_centroids": _tree("pt AS (SELECT i.g::VARCHAR AS label, depth_len * cos(2 * pi() * leaf_lo / (SELECT count(*) FROM tips)) AS x, depth_len * sin(2 * pi() * leaf_lo / (SELECT count(*) FROM tips)) AS y FROM indexed i WHERE kind = 'tip'), c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM pt GROUP BY label) SELECT label, round(cx, 5) AS cx, round(cy, 5) AS cy, n, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 5) AS reach FROM pt JOIN c USING (label) GROUP BY ALL"),
    "layout_rectangular": _tree("SELECT node_id, round(depth_len, 9) AS x, round((leaf_lo + leaf_lo + n_tips - 1) / 2.0, 9)::DOUBLE AS y FROM indexed WHERE kind <> 'root' UNION ALL SELECT 0, 0.0, round((min(m) + max(m)) / 2, 9)::DOUBLE FROM (SELECT (leaf_lo + leaf_lo + n_tips - 1) / 2.0 AS m FROM indexed WHERE kind = 'group')"),
    "layout_dendrogram": _tree("m AS (SELECT max(depth_len) AS m FROM indexed) SELECT node_id, round((leaf_lo + leaf_lo + n_tips - 1) / 2.0, 9)::DOUBLE AS x, round(m - depth_len, 9) AS y FROM indexed, m WHERE kind <> 'root' UNION ALL SELECT 0, round((min(q) + max(q)) / 2, 9)::DOUBLE, round(any_value(m), 9) FROM (SELECT (leaf_lo + leaf_lo + n_tips - 1) / 2.0 AS q FROM indexed WHERE kind = 'group'), m"),
    "layout_circular": _tree("r AS (SELECT node_id, depth_len, (leaf_lo + leaf_lo + n_tips - 1) / 2.0 AS row FROM indexed) SELECT node_id, round(depth_len * cos(2 * pi() * row / (SELECT count(*) FROM tips)), 5) AS x, round(depth_len * sin(2 * pi() * row / (SELECT count(*) FROM tips)), 5) AS y FROM r"),
    "layout_equal_angle": _tree("a AS (SELECT *, 2 * pi() * (leaf_lo + n_tips / 2.0) / (SELECT count(*) FROM tips) AS angle FROM indexed), s AS (SELECT *, coalesce(length, 0) * cos(angle) AS dx, coalesce(length, 0) * sin(angle) AS dy FROM a) SELECT s.node_id, round(s.dx + coalesce(p.dx, 0), 5) AS x, round(s.dy + coalesce(p.dy, 0), 5) AS y FROM s LEFT JOIN s p ON p.node_id = s.parent_id"),
    "circular_test": _tree(_SPLITS + """, o AS (SELECT name, row_number() OVER (ORDER BY g, k) - 1 AS place FROM tips), ins AS (SELECT g, o.place FROM (SELECT g, unnest(side) AS name FROM split WHERE tree_id = 'geo2') s JOIN o USING (name)),
      a AS (SELECT i.g, count(*) AS arcs FROM ins i WHERE NOT EXISTS (SELECT 1 FROM ins j WHERE j.g = i.g AND (j.place + 1) % (SELECT count(*) FROM tips) = i.place) GROUP BY i.g) SELECT arcs, arcs <= 1 AS circular, count(*) AS n FROM a GROUP BY ALL"""),
    "highlight_runs": _tree("""top AS (SELECT nation AS name, c_mktsegment AS v, count(*) AS n FROM orders_of GROUP BY ALL), seg AS (SELECT name, v FROM top QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, v DESC) = 1),
      t AS (SELECT leaf_lo AS o, v FROM indexed JOIN seg USING (name) WHERE kind = 'tip'), r AS (SELECT *, o - row_number() OVER (PARTITION BY v ORDER BY o) AS run FROM t) SELECT v AS value, min(o) AS lo, max(o) AS hi, count(*) AS n FROM r GROUP BY v, run"""),
    "ring_stack": _tree("rs AS (SELECT node_id, c_mktsegment, count(*) AS n FROM orders_of JOIN numbered ON name = nation AND kind = 'tip' GROUP BY ALL) SELECT node_id AS ord, c_mktsegment AS segment, round(n / sum(n) OVER (PARTITION BY node_id), 9) AS share FROM rs"),
    "color_scale_categorical": "SELECT value, ['#0072B2', '#E69F00', '#009E73', '#CC79A7', '#56B4E9', '#D55E00', '#F0E442', '#999999'][place + 1] AS color, place FROM (SELECT c_mktsegment AS value, row_number() OVER (ORDER BY c_mktsegment) - 1 AS place FROM (SELECT DISTINCT c_mktsegment FROM customer))",
    "color_scale_continuous": "SELECT min(c_acctbal) AS value, '#f7fbff' AS color FROM customer UNION ALL SELECT max(c_acctbal), '#08306b' FROM customer",
    "ace_continuous": _tree("""tr AS (SELECT n_name AS name, sum(c_acctbal::DECIMAL(15,2))::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
      gr AS (SELECT g, sum(v / len) / sum(1 / len) AS v, 1 / sum(1 / len) AS var, any_value(glen) AS glen FROM tips JOIN tr USING (name) GROUP BY g)
      SELECT node_id, round(v, 2) AS value FROM numbered JOIN tr USING (name) WHERE kind = 'tip' UNION ALL SELECT node_id, round(v, 2) FROM numbered n JOIN gr USING (g) WHERE kind = 'group' UNION ALL SELECT 0, round(sum(v / (var + glen)) / sum(1 / (var + glen)), 2) FROM gr"""),
    "ilr_balances": _tree("""gd AS (SELECT s.sample, t.name AS taxon, t.g, ln(coalesce(abundance, 0) + 1e-6) AS l FROM (SELECT DISTINCT sample FROM com) s CROSS JOIN tips t LEFT JOIN com c ON c.sample = s.sample AND c.taxon = t.name),
      wh AS (SELECT sample, sum(l) AS al, count(*) AS an FROM gd GROUP BY sample), bl AS (SELECT edge_id, sample, sum(l) AS l, count(*) AS n FROM paths JOIN gd USING (taxon) GROUP BY ALL)
      SELECT edge_id, sample, round(sqrt(n * (an - n) / an) * (l / n - (al - l) / (an - n)), 9) AS balance FROM bl JOIN wh USING (sample)"""),
    "tree_levelorder": _tree("SELECT depth AS depth_edges, node_id, name FROM numbered"),
    "tree_get_node": _tree("SELECT name, n_tips, leaf_lo, leaf_lo + n_tips - 1 AS leaf_hi FROM indexed WHERE name = 'EUROPE'"),
    "tree_has_lengths": "SELECT 'geo' AS tree_id, TRUE AS has_lengths",
    "tree_rotate": _tree("SELECT name, (CASE WHEN g = 0 THEN (SELECT count(*) FROM tips WHERE g = 0) - 1 - leaf_lo ELSE leaf_lo END)::INTEGER AS tip_ord FROM indexed WHERE kind = 'tip'"),
    "tree_flip": _tree("SELECT name, (row_number() OVER (ORDER BY CASE g WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE g END, k) - 1)::INTEGER AS tip_ord FROM tips"),
    "tree_group_otu": _tree('SELECT name, CASE WHEN g = 1 THEN \'west\' ELSE \'rest\' END AS "group" FROM tips'),
    "tree_outgroup_root": _tree("o AS (SELECT * FROM tips WHERE name = 'NATION_0') SELECT t.name, CASE WHEN t.name = o.name THEN o.len / 2 WHEN t.g = o.g THEN o.len / 2 + t.len ELSE o.len / 2 + o.glen + t.glen + t.len END AS depth_len FROM tips t, o"),
    "subtree_abundance": _tree("SELECT sample, edge_id, sum(abundance) AS total FROM com JOIN paths USING (taxon) GROUP BY ALL"),
    "fasta_entries": _aln("SELECT row_ord, '>' || name || chr(10) || substr(seq, 1, 60) || CASE WHEN length(seq) > 60 THEN chr(10) || substr(seq, 61, 60) ELSE '' END AS fasta FROM aln"),
    "aln_guess_type": _aln("SELECT 'orders' AS aln_id, CASE WHEN length(regexp_replace(t, '[^ACGTUN-]', '', 'g')) > 0.9 * length(t) THEN 'nucleotide' ELSE 'protein' END AS seqtype FROM (SELECT substr(string_agg(seq, '' ORDER BY row_ord), 1, 2000) AS t FROM aln)"),
    "aln_select_columns": _aln("SELECT name, substr(seq, 4, 1) || substr(seq, 1, 1) || substr(seq, 4, 1) AS seq FROM aln"),
    "group_mean_distances": _tree("SELECT least(a.g, b.g)::BIGINT AS a, greatest(a.g, b.g)::BIGINT AS b, round(avg(d), 9) AS d FROM dist2 JOIN tips a ON a.name = x JOIN tips b ON b.name = y GROUP BY ALL"),
    "heatmap_cells": _tree("""top AS (SELECT nation AS name, 'segment' AS c, 0 AS k, c_mktsegment AS v, count(*) AS n FROM orders_of GROUP BY ALL UNION ALL SELECT nation, 'priority', 1, o_orderpriority, count(*) FROM orders_of GROUP BY ALL),
      ch AS (SELECT name, c, k, v FROM top QUALIFY row_number() OVER (PARTITION BY name, c ORDER BY n DESC, v DESC) = 1), m AS (SELECT max(depth_len) AS m FROM indexed)
      SELECT node_id AS ord, c || '=' || v AS text, round(m * 1.02 + m * 0.05 * ch.k, 9) AS x, leaf_lo - 0.5::DOUBLE AS y FROM indexed i JOIN ch USING (name), m WHERE kind = 'tip'"""),
    "bar_track": _tree("tr AS (SELECT n_name AS name, sum(c_acctbal::DECIMAL(15,2))::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), m AS (SELECT max(depth_len) AS m FROM indexed) SELECT node_id AS ord, round(m * 0.2 * greatest(v, 0) / (SELECT max(greatest(v, 0)) FROM tr), 9) AS width FROM indexed JOIN tr USING (name), m WHERE kind = 'tip'"),
    "geo_bands": _tree("""p(period, young, old) AS (VALUES ('Quaternary', 0.0, 2.58), ('Neogene', 2.58, 23.03), ('Paleogene', 23.03, 66.0), ('Cretaceous', 66.0, 145.0), ('Jurassic', 145.0, 201.4), ('Triassic', 201.4, 251.9), ('Permian', 251.9, 298.9), ('Carboniferous', 298.9, 358.9), ('Devonian', 358.9, 419.2)),
      m AS (SELECT max(100 * depth_len) AS m FROM indexed) SELECT period, round(m - least(old, m), 9)::DOUBLE AS x0, round(m - young, 9)::DOUBLE AS x1 FROM p, m WHERE young < m"""),
    "scale_bar": _tree("m AS (SELECT max(depth_len) / 10 AS r FROM indexed), q AS (SELECT r, pow(10, floor(log10(r))) AS p FROM m), z AS (SELECT CASE WHEN r / p >= 5 THEN 5 * p WHEN r / p >= 2 THEN 2 * p ELSE p END AS size FROM q) SELECT printf('%.6g', size) AS text, round(size, 9) AS size FROM z"),
    "node_markers": _tree("SELECT node_id AS ord, name, depth_len AS x FROM numbered WHERE kind <> 'tip'"),
    "elbow_paths": _tree("""r AS (SELECT node_id, parent_id, depth_len AS x, (leaf_lo + leaf_lo + n_tips - 1) / 2.0::DOUBLE AS y FROM indexed)
      SELECT c.node_id, 'branch' AS part, p.x AS x0, c.y AS y0, c.x AS x1, c.y AS y1 FROM r c JOIN r p ON p.node_id = c.parent_id
      UNION ALL SELECT p.node_id, 'connector', any_value(p.x), min(c.y), any_value(p.x), max(c.y) FROM r c JOIN r p ON p.node_id = c.parent_id GROUP BY p.node_id"""),
    "camin_sokal": f"WITH {_CHARS}, d AS (SELECT character, state, dense_rank() OVER (PARTITION BY character ORDER BY state) AS code FROM (SELECT DISTINCT character, state FROM ch WHERE state <> 'BUILDING')), x AS (SELECT n_regionkey AS g, character, coalesce(code, 0) AS code FROM ch LEFT JOIN d USING (character, state) JOIN nation ON n_name = name), s AS (SELECT g, character, CASE WHEN min(code) = max(code) AND min(code) > 0 THEN 1 ELSE count(*) FILTER (code > 0) END AS c FROM x GROUP BY ALL) SELECT 'geo' AS tree_id, sum(c)::DOUBLE AS score FROM s",
    "mantel_spearman": _tree("""items AS (SELECT name AS item FROM tips), spread AS (SELECT item, p::INTEGER AS perm_id, md5('3|' || p || '|' || item) AS said FROM items, range(1, 100) t(p)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY perm_id ORDER BY item) AS i, row_number() OVER (PARTITION BY perm_id ORDER BY said, item) AS j FROM spread),
      moves AS (SELECT a.perm_id, a.item, b.item AS other FROM placed a JOIN placed b ON a.perm_id = b.perm_id AND a.i = b.j UNION ALL SELECT 0, item, item FROM items),
      ra AS (SELECT x, y, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS da FROM dist), rb AS (SELECT x, y, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS db FROM dist2),
      moved AS (SELECT p.perm_id, least(p.other, q.other) AS x, greatest(p.other, q.other) AS y, da FROM ra JOIN moves p ON p.item = x JOIN moves q ON q.item = y AND q.perm_id = p.perm_id),
      r AS (SELECT perm_id, corr(da, db) AS r, count(*) AS n FROM moved JOIN rb USING (x, y) GROUP BY perm_id), o AS (SELECT r AS r0, n FROM r WHERE perm_id = 0)
      SELECT round(any_value(r0), 9) AS r, round((count(*) FILTER (abs(r) >= abs(r0) - 1e-12) + 1) / (count(*) + 1), 9) AS p, any_value(o.n) AS n_pairs FROM r, o WHERE perm_id > 0"""),
    "permanova": _tree("""f AS (SELECT sample, edge_id, any_value(length) AS length, sum(abundance) / any_value(whole) AS f FROM (SELECT *, sum(abundance) OVER (PARTITION BY sample) AS whole FROM com) c JOIN paths USING (taxon) GROUP BY sample, edge_id),
      s AS (SELECT DISTINCT sample FROM f), e AS (SELECT DISTINCT edge_id, length FROM f),
      xx AS (SELECT a.sample AS a, b.sample AS b, e.length, coalesce(fa.f, 0) AS fa, coalesce(fb.f, 0) AS fb FROM s a JOIN s b ON a.sample < b.sample CROSS JOIN e LEFT JOIN f fa ON fa.sample = a.sample AND fa.edge_id = e.edge_id LEFT JOIN f fb ON fb.sample = b.sample AND fb.edge_id = e.edge_id),
      u AS (SELECT a AS x, b AS y, round(sum(length * abs(fa - fb)) / sum(length * (fa + fb)), 9) AS d FROM xx GROUP BY a, b),
      gr AS (SELECT sample AS item, split_part(sample, '|', 1) AS label FROM s), spread AS (SELECT item, p::INTEGER AS perm_id, md5('5|' || p || '|' || item) AS said FROM gr, range(1, 100) t(p)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY perm_id ORDER BY item) AS i, row_number() OVER (PARTITION BY perm_id ORDER BY said, item) AS j FROM spread),
      lab AS (SELECT a.perm_id, a.item, g.label FROM placed a JOIN placed b ON a.perm_id = b.perm_id AND a.i = b.j JOIN gr g ON g.item = b.item UNION ALL SELECT 0, item, label FROM gr),
      sz AS (SELECT label, count(*) AS m FROM gr GROUP BY label), t AS (SELECT sum(d * d) / (SELECT count(*) FROM gr) AS total FROM u),
      wi AS (SELECT perm_id, sum(ss / m) AS within FROM (SELECT p.perm_id, p.label, sum(d * d) AS ss FROM u JOIN lab p ON p.item = x JOIN lab q ON q.item = y AND q.perm_id = p.perm_id WHERE p.label = q.label GROUP BY ALL) JOIN sz USING (label) GROUP BY perm_id),
      nk AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM gr), fs AS (SELECT perm_id, n, k, (total - within) / (k - 1) / (within / (n - k)) AS f, 1 - within / total AS r2 FROM wi, t, nk), o AS (SELECT f AS f0, r2, n, k FROM fs WHERE perm_id = 0)
      SELECT round(any_value(f0), 9) AS f, round(any_value(o.r2), 9) AS r2, round((count(*) FILTER (fs.f >= f0 - 1e-12) + 1) / (count(*) + 1), 9) AS p, any_value(o.n) AS n, any_value(o.k) AS k FROM fs, o WHERE perm_id > 0"""),
    "tree_swap_children": _tree("SELECT name, (CASE WHEN g = 0 THEN [1, 2, 0, 4, 3][leaf_lo + 1] ELSE leaf_lo END)::INTEGER AS tip_ord FROM indexed WHERE kind = 'tip'"),
    "tree_leaf_names": _tree("SELECT gname AS name, string_agg(name, '|' ORDER BY k) AS leaves FROM tips GROUP BY gname UNION ALL SELECT 'root', string_agg(name, '|' ORDER BY g, k) FROM tips"),
    "primates_joined": "SELECT name, depth_len::DOUBLE AS depth_len, habitat, body_mass_kg FROM (VALUES ('Human', 0.3, 'urban', 62), ('Chimp', 0.3, 'forest', 45), ('Gorilla', 0.3, 'forest', 160), ('Orangutan', 0.32, 'forest', 75), ('Gibbon', 0.3, 'forest', 8), ('Macaque', 0.32, 'savanna', 11), ('Baboon', 0.3, 'savanna', 25)) t(name, depth_len, habitat, body_mass_kg)",
    "taxon_like_labels": "SELECT label, regexp_matches(trim(label), '^\\p{Lu}') AS taxon FROM (SELECT n_name AS label FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer UNION SELECT event_type FROM events UNION SELECT o_orderpriority FROM orders)",
    "layout_cladogram": _tree("SELECT node_id, depth::DOUBLE AS x, ((leaf_lo + leaf_lo + n_tips - 1) / 2.0)::DOUBLE AS y FROM indexed"),
    "layout_inward": _tree("r AS (SELECT node_id, max(depth_len) OVER () - depth_len AS radius, 2 * pi() * (leaf_lo + leaf_lo + n_tips - 1) / 2.0 / (SELECT count(*) FROM tips) AS angle FROM indexed) SELECT node_id, round(radius * cos(angle), 5) AS x, round(radius * sin(angle), 5) AS y FROM r"),
    "slanted_paths": _tree(_PLACED + "SELECT c.node_id AS ord, p.x AS x0, p.y AS y0, c.x AS x1, c.y AS y1 FROM r c JOIN r p ON p.node_id = c.parent_id"),
    "circular_paths": _tree(_PLACED + """, o AS (SELECT *, 2 * pi() * y / (SELECT count(*) FROM tips) AS angle FROM r), k AS (SELECT p.node_id, p.x, min(c.angle) AS a, max(c.angle) AS b FROM o c JOIN o p ON p.node_id = c.parent_id GROUP BY ALL)
      SELECT c.node_id, 'branch' AS part, round(p.x * cos(c.angle), 5) AS x1, round(p.x * sin(c.angle), 5) AS y1, round(c.x * cos(c.angle), 5) AS x0, round(c.x * sin(c.angle), 5) AS y0 FROM o c JOIN o p ON p.node_id = c.parent_id
      UNION ALL SELECT node_id, 'connector', round(x * cos(a), 5), round(x * sin(a), 5), round(x * cos(b), 5), round(x * sin(b), 5) FROM k"""),
    "tip_label_scene": _tree("SELECT node_id AS ord, name, 'true' AS italic, round(depth_len, 9) AS x0, leaf_lo::DOUBLE AS y0 FROM indexed WHERE kind = 'tip'"),
    "node_label_scene": _tree("SELECT node_id AS ord, name, round(depth_len, 9) AS x0, ((leaf_lo + leaf_lo + n_tips - 1) / 2.0)::DOUBLE AS y0 FROM indexed WHERE kind = 'group'"),
    "highlight_clade": _tree("b AS (SELECT node_id, name, depth_len AS l, (SELECT max(depth_len) FROM indexed) AS r, (leaf_lo - 0.5)::DOUBLE AS lo, (leaf_lo + n_tips - 0.5)::DOUBLE AS hi FROM indexed WHERE name = 'ASIA') SELECT node_id AS ord, name, '#ff0000' AS color, 0.3::DOUBLE AS alpha, round(l, 9) AS x0, lo AS y0, round(r, 9) AS x1, lo AS y1, round(r, 9) AS x2, hi AS y2, round(l, 9) AS x3, hi AS y3 FROM b"),
    "clade_label_scene": _tree("b AS (SELECT node_id AS ord, round((SELECT max(depth_len) FROM indexed) * 1.05, 9) AS x, leaf_lo::DOUBLE AS lo, (leaf_lo + n_tips - 1)::DOUBLE AS hi FROM indexed WHERE name = 'ASIA') SELECT ord, 'path' AS kind, NULL AS text, x AS x0, lo AS y0, x AS x1, hi AS y1 FROM b UNION ALL SELECT ord, 'label', 'Asia', x, (lo + hi) / 2, NULL, NULL FROM b"),
    "connection_curves": _tree("""n AS (SELECT name, depth_len AS x, (leaf_lo + leaf_lo + n_tips - 1) / 2.0::DOUBLE AS y FROM indexed), m AS (SELECT max(depth_len) AS m FROM indexed)
      SELECT a.name || '-' || b.name AS text, round(a.x, 9) AS x0, round(a.y, 9) AS y0, round(a.x / 4 + ((a.x + b.x) / 2 + m * 0.3) / 2 + b.x / 4, 9) AS x10, round((a.y + b.y) / 2, 9) AS y10, round(b.x, 9) AS x20, round(b.y, 9) AS y20
      FROM region JOIN n a ON a.name = 'NATION_' || r_regionkey JOIN n b ON b.name = r_name, m"""),
    "domain_blocks": _tree("""b AS (SELECT nation, c_mktsegment AS domain, count(*) AS n FROM orders_of GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY nation ORDER BY domain) AS upto FROM b), whole AS (SELECT max(upto) AS z FROM u), m AS (SELECT max(depth_len) AS m FROM indexed)
      SELECT node_id AS ord, domain, round(m * 1.02 + m * 0.6 * (upto - n) / z, 9)::DOUBLE AS x0, (leaf_lo - 0.35)::DOUBLE AS y0, round(m * 1.02 + m * 0.6 * upto / z, 9)::DOUBLE AS x1, (leaf_lo - 0.35)::DOUBLE AS y1 FROM u JOIN indexed ON name = nation AND kind = 'tip', whole, m"""),
    "collapsed_triangles": _tree("SELECT 1::INTEGER AS ord, count(*)::VARCHAR AS n, min(glen)::DOUBLE AS x0, 0.0::DOUBLE AS y0, round(min(glen) + max(len), 9) AS x1, -0.4::DOUBLE AS y1, round(min(glen) + min(len), 9) AS x2, 0.4::DOUBLE AS y2 FROM tips WHERE gname = 'AFRICA'"),
    "alignment_rows": _aln("t AS (SELECT n_name AS name, (1 + n_regionkey + row_number() OVER (ORDER BY n_regionkey, n_nationkey))::INTEGER AS ord FROM nation) SELECT ord, string_agg(CASE ch WHEN '-' THEN -1 ELSE ascii(ch) - 65 END, ',' ORDER BY col) AS codes FROM sites JOIN t USING (name) GROUP BY ord"),
    "point_shapes": _tree(_SEGMENTS + "SELECT node_id AS ord, ['o', 's', '^', 'D', 'v'][ranked.k] AS marker, ['#0072B2', '#E69F00', '#009E73', '#CC79A7', '#56B4E9'][ranked.k] AS color FROM indexed JOIN ranked ON name = nation WHERE kind = 'tip'"),
    "point_sizes": _tree("tr AS (SELECT n_name AS name, sum(c_acctbal::DECIMAL(15,2))::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT node_id AS ord, round(4 + 12 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS size FROM indexed JOIN tr USING (name) WHERE kind = 'tip'"),
    "scene_bounds": _tree("SELECT 'geo' AS fig_id, 0.0::DOUBLE AS min_x, max(depth_len) AS max_x, 0.0::DOUBLE AS min_y, max(leaf_lo)::DOUBLE AS max_y FROM indexed"),
    "mirrored_paths": _tree(_PLACED + "SELECT c.node_id AS ord, 5 - p.x AS x0, 2 * p.y AS y0, 5 - c.x AS x1, 2 * c.y AS y1 FROM r c JOIN r p ON p.node_id = c.parent_id"),
    "panel_places": _tree("n AS (SELECT count(*) FILTER (kind <> 'root') AS edges, count(*) FILTER (kind = 'tip') AS tips, count(*) FILTER (kind <> 'tip') AS inner_nodes FROM numbered) SELECT 0 AS panel, 0 AS panel_row, 0 AS panel_col, edges AS n FROM n UNION ALL SELECT 1, 0, 1, tips FROM n UNION ALL SELECT 3, 1, 1, edges + inner_nodes FROM n"),
    "ribbon_spans": _tree("o AS (SELECT t.gname AS label, row_number() OVER (ORDER BY t.g, t.k) - 1 AS l, row_number() OVER (ORDER BY u.g, u.k) - 1 AS r FROM tips t JOIN tips2 u USING (name)) SELECT label, min(l)::INTEGER AS lo_a, max(l)::INTEGER AS hi_a, min(r)::INTEGER AS lo_b, max(r)::INTEGER AS hi_b FROM o GROUP BY label"),
    "legend_entries": "SELECT 'geo' AS fig_id, 'legend' AS kind, (k - 1)::INTEGER AS ord, value AS text, 'segment' AS title, ['#0072B2', '#E69F00', '#009E73', '#CC79A7', '#56B4E9', '#D55E00', '#F0E442', '#999999'][k] AS color, 'patch' AS swatch FROM (SELECT value, row_number() OVER (ORDER BY value) AS k FROM (SELECT DISTINCT c_mktsegment AS value FROM customer))",
    "colorbar_ends": "SELECT 'geo' AS fig_id, 'colorbar' AS kind, 'c_acctbal' AS text, min(c_acctbal)::DOUBLE AS lo, max(c_acctbal)::DOUBLE AS hi, '#f7fbff' AS first, 8::INTEGER AS stops FROM customer",
    "network_pairs": _tree("e AS (SELECT x, y, CASE WHEN d < 2 THEN 1 / d ELSE 1.0 END::DOUBLE AS w FROM dist WHERE d < 4.5) SELECT name, count(*) AS degree, round(sum(w), 9) AS weight FROM (SELECT x AS name, w FROM e UNION ALL SELECT y, w FROM e) GROUP BY name"),
    "network_colors": _tree("c AS (SELECT label, row_number() OVER (ORDER BY label = 'AMERICA', label) AS k FROM (SELECT DISTINCT gname AS label FROM tips)) SELECT name, label, CASE WHEN label = 'AMERICA' THEN '#cccccc' ELSE ['#0072B2', '#E69F00', '#009E73', '#CC79A7', '#56B4E9'][c.k] END AS color FROM tips JOIN c ON label = gname"),
    "network_labels": _tree("SELECT 0::INTEGER AS ord, name, round(depth_len, 9) AS x0, leaf_lo::DOUBLE AS y0 FROM indexed WHERE name IN ('NATION_3', 'NATION_11')"),
    "fitch_parsimony": _aln("""mask AS (SELECT n_regionkey AS g, n_nationkey AS k, col, CASE ch WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 15 END::BIGINT AS m FROM sites JOIN nation ON n_name = name),
      inner_node AS (SELECT g, col, list_reduce(list(m ORDER BY k), lambda a, b: CASE WHEN ((a & 15) & b) = 0 THEN (a + 16) | b ELSE a - (a & 15) + ((a & 15) & b) END) AS r FROM mask GROUP BY g, col),
      top AS (SELECT col, sum(r // 16) AS below, list_reduce(list(r & 15 ORDER BY g), lambda a, b: CASE WHEN ((a & 15) & b) = 0 THEN (a + 16) | b ELSE a - (a & 15) + ((a & 15) & b) END) AS r FROM inner_node GROUP BY col)
      SELECT 'orders' AS tree_id, sum(below + r // 16)::DOUBLE AS score FROM top"""),
    "rogue_taxon": _tree(_ROGUE + "SELECT 'geo' AS a, 'geo2' AS b, round(o.rf, 9) AS rf, w.wo AS taxon, round(w.rf, 9) AS rf_without, round(CASE WHEN o.rf > 0 THEN (o.rf - w.rf) / o.rf ELSE 0 END, 9)::DOUBLE AS explained FROM best w, rf o WHERE o.wo = ''"),
    "gene_tree_conflict": _tree(_ROGUE + """, nb AS (SELECT a.name AS x, b.name AS y, 'a' AS t FROM tips a JOIN tips b ON a.g = b.g AND a.name <> b.name UNION ALL SELECT a.name, b.name, 'b' FROM tips2 a JOIN tips2 b ON a.g = b.g AND a.name <> b.name),
      moved AS (SELECT x, 1 - count(*) FILTER (c = 2) / count(*) AS v FROM (SELECT x, y, count(*) AS c FROM nb GROUP BY ALL) GROUP BY x)
      SELECT 'geo2' AS gene, round(o.rf, 9) AS rf, w.wo AS taxon, round((SELECT avg(v) FROM moved), 9) AS mean_displacement, (SELECT count(*) FROM moved) AS n_shared FROM best w, rf o WHERE o.wo = ''"""),
    "stream_community_pd": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS sample, event_type AS taxon, count(*)::DOUBLE AS abundance FROM events GROUP BY ALL",
}
