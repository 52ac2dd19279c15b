"""DuckDB SQL for mutations and crossovers: the same draws by MD5, the same trees by arithmetic."""

from __future__ import annotations

_COLUMNS = "tree_id, node_idx, node_type, parent_idx, depth, p1, p2, p3, p4"


def drawn(seed: int, name: str | None, *key: str) -> str:
    """SQL of a number in [0, 1): 52 bits of the digest of seed, name (if any) and key."""
    parts = [str(seed), *([repr(name)] if name else []), *key]
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def action(seed: int, branch: str, *key: str) -> list[str]:
    kind = f"(CASE WHEN {branch} = 1 THEN floor(1 + 2 * {drawn(seed, 'kind', *key)}) ELSE floor(3 + 4 * {drawn(seed, 'kind', *key)}) END)"
    ratio = f"CASE WHEN {kind} <> 3 THEN {drawn(seed, 'ratio', *key)} ELSE 0 END"
    return [kind, ratio, f"CASE WHEN {kind} NOT IN (3, 4) THEN floor(1 + 100 * {drawn(seed, 'leverage', *key)}) ELSE 0 END", "0.0::DOUBLE"]


def decision(seed: int, *key: str) -> list[str]:
    """Over four features: two numbers up to 200 and 300, and two to be compared with each other."""
    which = f"floor(4 * {drawn(seed, 'feature', *key)})"
    value = drawn(seed, "value", *key)
    return [which, f"floor(2 * {drawn(seed, 'op', *key)})", f"CASE WHEN {which} >= 2 THEN 1 ELSE 0 END", f"CASE {which} WHEN 0 THEN 200 * {value} WHEN 1 THEN 300 * {value} WHEN 2 THEN 3 ELSE 2 END"]


def named(values: list[str]) -> str:
    return ", ".join(f"CAST({v} AS DOUBLE) AS p{i}" for i, v in enumerate(values, 1))


def shape(nodes: str, tag: str = "") -> str:
    """CTEs: under (every node below and at every node), kids, and info with the branch and counts of every node."""
    return f"""under{tag} AS (SELECT tree_id, node_idx, node_idx AS top FROM {nodes} UNION ALL SELECT n.tree_id, n.node_idx, u.top FROM {nodes} n JOIN under{tag} u ON n.tree_id = u.tree_id AND n.parent_idx = u.node_idx),
kids{tag} AS (SELECT tree_id, parent_idx AS node_idx, count(*) AS kids, count(*) FILTER (node_type = 3) AS acts FROM {nodes} WHERE parent_idx >= 0 GROUP BY ALL),
size{tag} AS (SELECT tree_id, top AS node_idx, count(*) AS size FROM under{tag} GROUP BY ALL),
info{tag} AS (SELECT n.*, r.p1 AS branch, coalesce(k.kids, 0) AS kids, coalesce(k.acts, 0) AS acts, s.kids AS siblings, z.size FROM {nodes} n JOIN under{tag} u USING (tree_id, node_idx) JOIN {nodes} r ON r.tree_id = n.tree_id AND r.node_idx = u.top AND r.node_type = 1
  LEFT JOIN kids{tag} k ON k.tree_id = n.tree_id AND k.node_idx = n.node_idx LEFT JOIN kids{tag} s ON s.tree_id = n.tree_id AND s.node_idx = n.parent_idx JOIN size{tag} z ON z.tree_id = n.tree_id AND z.node_idx = n.node_idx)"""


def picked(seed: int, name: str, rows: str, weight: str) -> str:
    """A CTE c with one node of each tree, the one whose exponential key is the least."""
    return f"c AS (SELECT tree_id, arg_min((node_idx, parent_idx, depth, branch), -ln(1 - {drawn(seed, name, 'tree_id', 'node_idx')}) / ({weight})) AS x FROM {rows} GROUP BY tree_id)"


def with_node(seed: int, tag: str = "") -> str:
    """CTEs up to more: every tree with one decision more, on an edge drawn by one over the depth."""
    return f"""cut AS (SELECT tree_id, arg_min((node_idx, parent_idx, depth), -ln(1 - {drawn(seed, 'add_node', 'tree_id', 'node_idx')}) * depth) AS x FROM nodes WHERE parent_idx >= 0 GROUP BY tree_id),
more AS (SELECT n.tree_id, n.node_idx, n.node_type, CASE WHEN n.node_idx = x[1] THEN 15 ELSE n.parent_idx END AS parent_idx, n.depth + CASE WHEN x[1] IN (n.node_idx, n.parent_idx) THEN 1 ELSE 0 END AS depth, p1, p2, p3, p4 FROM nodes n JOIN cut USING (tree_id)
  UNION ALL SELECT tree_id, 15, 2, x[2], x[3], {named(decision(seed, 'tree_id', 'x[1]'))} FROM cut)"""


def oracles(trees: str) -> dict[str, str]:
    """SQL by query; trees: the CTEs t, r, k and nodes of trees with three roots, two decisions under each and an action under each of those."""
    deeper = f"WITH RECURSIVE {trees}, {with_node(9)}, {shape('more')}"
    branch = "CASE node_type WHEN 1 THEN node_idx WHEN 2 THEN (node_idx - 3) // 4 ELSE (node_idx - 5) // 4 END"
    around = f"(2 * {drawn(1, 'amount', 'tree_id', 'node_idx')} - 1)"
    top = "CASE p1 WHEN 0 THEN 200 WHEN 1 THEN 300 END"
    out = {
        "mutate_parameters": f"""WITH {trees}, h AS (SELECT *, {drawn(1, 'parameter', 'tree_id', 'node_idx')} < 0.5 AND node_type = 2 AS ask, {drawn(1, 'parameter', 'tree_id', 'node_idx')} < 0.5 AND node_type = 3 AS act FROM nodes)
SELECT tree_id, node_idx, node_type, parent_idx, depth, p1, CASE WHEN ask AND p3 <> 2 THEN floor(2 * {drawn(1, 'op', 'tree_id', 'node_idx')}) WHEN act AND p1 <> 3 THEN greatest(0, least(1, p2 + 0.1::DOUBLE * {around})) ELSE p2 END AS p2,
  CASE WHEN act AND p1 NOT IN (3, 4) THEN greatest(1, least(100, p3 + round(5 * {around}))) ELSE p3 END AS p3,
  CASE WHEN ask AND p3 = 0 AND p1 < 2 THEN greatest(0, least({top}, p4 + {top} * 0.1::DOUBLE * {around})) ELSE p4 END AS p4 FROM h""",
        "reinitialize_nodes": f"""WITH {trees}, h AS (SELECT *, {branch} AS branch, {drawn(1, 'renew', 'tree_id', 'node_idx')} < 0.5 AS hit FROM nodes),
n AS (SELECT tree_id, node_idx, {named(action(1, 'branch', 'tree_id', 'node_idx'))}, true AS hit, 3 AS node_type FROM h UNION ALL SELECT tree_id, node_idx, {named(decision(1, 'tree_id', 'node_idx'))}, true, 2 FROM h)
SELECT h.tree_id, node_idx, node_type, parent_idx, depth, {', '.join(f'coalesce(n.p{i}, h.p{i}) AS p{i}' for i in range(1, 5))} FROM h LEFT JOIN n USING (tree_id, node_idx, node_type, hit)""",
        "add_node": f"WITH {trees}, {with_node(1)} SELECT {_COLUMNS} FROM more",
        "delete_node": f"""{deeper}, can AS (SELECT * FROM info WHERE node_type = 2 AND (acts = 0 OR siblings = 1)), {picked(1, 'delete_node', 'can', 'kids + 1e-6::DOUBLE')}
SELECT m.tree_id, m.node_idx, m.node_type, CASE WHEN m.parent_idx = x[1] THEN x[2] ELSE m.parent_idx END AS parent_idx, m.depth - CASE WHEN u.top IS NULL THEN 0 ELSE 1 END AS depth, p1, p2, p3, p4
FROM more m LEFT JOIN c USING (tree_id) LEFT JOIN under u ON u.tree_id = m.tree_id AND u.node_idx = m.node_idx AND u.top = x[1] WHERE x IS NULL OR m.node_idx <> x[1]""",
        "delete_subtree": f"""{deeper}, lift AS (SELECT i.tree_id, i.node_idx, arg_max(a.node_idx, a.depth) AS top FROM info i JOIN under u USING (tree_id, node_idx) JOIN info a ON a.tree_id = i.tree_id AND a.node_idx = u.top AND a.node_type <> 1 AND a.siblings > 1 WHERE i.node_type <> 1 GROUP BY ALL),
can AS (SELECT info.* FROM info JOIN lift USING (tree_id, node_idx)), {picked(1, 'delete_subtree', 'can', 'size')}, gone AS (SELECT u.tree_id, u.node_idx FROM c JOIN lift l ON l.tree_id = c.tree_id AND l.node_idx = x[1] JOIN under u ON u.tree_id = l.tree_id AND u.top = l.top)
SELECT {_COLUMNS} FROM more ANTI JOIN gone USING (tree_id, node_idx)""",
        "add_subtree": f"""{deeper}, can AS (SELECT * FROM info WHERE kids > 0 AND acts = 0 AND kids + 3 <= 30 AND depth + 2 < 6), {picked(1, 'add_subtree', 'can', '(30 - kids) / (depth + 1.0::DOUBLE)')},
s AS (SELECT tree_id, x[1] AS spot, x[3] AS level, x[4] AS side, CAST(floor(1 + 3 * {drawn(1, 'length', 'tree_id')}) AS INT) AS n, (SELECT max(node_idx) FROM more m WHERE m.tree_id = c.tree_id) AS last FROM c),
g AS (SELECT tree_id, spot, level, side, n, last, 0 AS k, []::INT[] AS ups, []::INT[] AS deep FROM s
  UNION ALL SELECT tree_id, spot, level, side, n, last, k + 1, list_append(ups, CASE WHEN nested THEN d ELSE 0 END), list_append(deep, CASE WHEN nested THEN deep[d] ELSE level END + 1)
  FROM (SELECT *, d > 0 AND deep[d] + 2 < 6 AS nested FROM (SELECT *, CAST(floor((k + 1) * {drawn(1, 'under', 'tree_id', 'k + 1')}) AS INT) AS d FROM g WHERE k < n))),
e AS (SELECT *, generate_subscripts(ups, 1) AS j FROM g WHERE k = n),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY j) AS nth FROM e WHERE NOT list_contains(ups, j))
SELECT {_COLUMNS} FROM more UNION ALL SELECT tree_id, last + j, 2, CASE WHEN ups[j] = 0 THEN spot ELSE last + ups[j] END, deep[j], {named(decision(1, 'tree_id', 'j'))} FROM e
UNION ALL SELECT tree_id, last + n + nth, 3, last + j, deep[j] + 1, {named(action(1, 'side', 'tree_id', 'j'))} FROM leaf""",
    }
    pairs = f"p AS (SELECT tree_id AS child, tree_id AS first, (tree_id * 3 + 1) % (SELECT max(user_id) + 1 FROM events) AS second FROM t), n AS (SELECT *, {branch} AS b FROM nodes)"
    out["root_branch_crossover"] = f"""WITH {trees}, {pairs}, d AS (SELECT child, b, CASE WHEN {drawn(5, 'branch', 'child', 'b')} < 0.5 THEN first ELSE second END AS donor FROM p, r)
SELECT d.child AS tree_id, n.node_idx, n.node_type, n.parent_idx, n.depth, n.p1, n.p2, n.p3, n.p4 FROM d JOIN n ON n.tree_id = d.donor AND n.b = d.b"""
    for name, place in (("", "b"), ("_free", "CASE b WHEN 1 THEN 1 ELSE 0 END")):
        ranked = lambda which, salt, place=place: f"(SELECT child, n.*, {place} AS place, row_number() OVER w AS rank, count(*) OVER (PARTITION BY child, node_type, {place}) AS many FROM p JOIN n ON tree_id = {which} WHERE node_type > 1 WINDOW w AS (PARTITION BY child, node_type, {place} ORDER BY {drawn(5, salt, 'child', 'node_idx')}))"
        out[f"node_crossover{name}"] = f"""WITH {trees}, {pairs}, own AS {ranked('first', 'own')}, other AS {ranked('second', 'other')},
s AS (SELECT own.child, own.node_idx, other.p1, other.p2, other.p3, other.p4 FROM own JOIN other USING (child, node_type, place, rank) WHERE rank <= greatest(1, least(own.many, other.many) / 2))
SELECT p.child AS tree_id, n.node_idx, node_type, parent_idx, depth, {', '.join(f'coalesce(s.p{i}, n.p{i}) AS p{i}' for i in range(1, 5))} FROM p JOIN n ON tree_id = first LEFT JOIN s ON s.child = p.child AND s.node_idx = n.node_idx"""
        out[f"subtree_crossover{name}"] = f"""WITH {trees}, {pairs}, a AS {ranked('first', 'a')}, o AS {ranked('second', 'b')},
c AS (SELECT child, arg_min((a.node_idx, a.parent_idx, o.node_idx), {drawn(5, 'pick', 'child', 'node_type', 'place', 'rank')}) AS x FROM a JOIN o USING (child, node_type, place, rank) GROUP BY child),
parts AS (SELECT child, 1 AS part, n.*, 1 AS up_part FROM p JOIN c USING (child) JOIN n ON tree_id = first WHERE node_idx <> x[1] AND parent_idx <> x[1]
  UNION ALL SELECT child, 2, n.* REPLACE (CASE WHEN node_idx = x[3] THEN x[2] ELSE parent_idx END AS parent_idx), CASE WHEN node_idx = x[3] THEN 1 ELSE 2 END FROM p JOIN c USING (child) JOIN n ON tree_id = second WHERE x[3] IN (node_idx, parent_idx)),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY child ORDER BY node_type <> 1, CASE WHEN node_type = 1 THEN b END, part, node_idx) - 1 AS INT) AS new FROM parts)
SELECT i.child AS tree_id, i.new AS node_idx, i.node_type, coalesce(u.new, -1) AS parent_idx, i.depth, i.p1, i.p2, i.p3, i.p4 FROM i LEFT JOIN i u ON u.child = i.child AND u.part = i.up_part AND u.node_idx = i.parent_idx"""
    return out
