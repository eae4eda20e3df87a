"""Ordered patches: lists of a user's events as rows, and the events as patches to them, good and bad ones, whose twin replays them one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import patches
from pathloom.plans.registry import query

# event_id % 8 is what a patch does, event_id % 13 its row; every tenth index is no number, many are out of range or behind a removal
_ROWS = "SELECT user_id AS pathway_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CASE WHEN event_id % 3 > 0 THEN concat('n', event_id) END AS name, CASE WHEN event_id % 4 > 0 THEN event_type END AS state FROM {events}"
_AT = "CASE WHEN event_id % 10 = 9 THEN 'x' WHEN event_id % 8 = 6 THEN '-' ELSE CAST(event_id % 13 AS STRING) END"
_PATCHES = """SELECT user_id AS pathway_id, event_id AS seq, CASE event_id % 8 WHEN 1 THEN 'remove' WHEN 2 THEN 'replace' WHEN 4 THEN 'remove' WHEN 5 THEN 'replace' ELSE 'add' END AS op,
    concat('/', """ + _AT + """, CASE event_id % 8 WHEN 2 THEN '/name' WHEN 3 THEN '/state' WHEN 4 THEN '/state' WHEN 7 THEN '/colour' ELSE '' END) AS path,
    CASE WHEN event_id % 8 IN (2, 3, 7) THEN concat('v', event_id) WHEN event_id % 8 IN (0, 5, 6) THEN to_json(named_struct('name', concat('p', event_id))) END AS value FROM {events}"""

_REPLAY = """WITH RECURSIVE r AS (SELECT user_id AS pathway_id, list({'name': CASE WHEN event_id % 3 > 0 THEN concat('n', event_id) END, 'state': CASE WHEN event_id % 4 > 0 THEN event_type END} ORDER BY event_id) AS l FROM events GROUP BY 1),
    p AS (SELECT user_id AS pathway_id, event_id AS seq, event_id % 8 AS k, concat('v', event_id) AS v, concat('p', event_id) AS fresh, CASE WHEN event_id % 10 <> 9 THEN event_id % 13 END AS i, event_id % 10 = 9 AS odd, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
    go(pathway_id, step, l, seq, ok) AS (SELECT pathway_id, CAST(0 AS BIGINT), l, CAST(NULL AS BIGINT), true FROM r
      UNION ALL SELECT g.pathway_id, p.step, CASE WHEN NOT good THEN g.l WHEN k = 6 THEN list_append(g.l, {'name': fresh, 'state': NULL}) WHEN k = 1 THEN list_concat(g.l[:i], g.l[i + 2:])
            WHEN k = 0 THEN list_concat(g.l[:i], [{'name': fresh, 'state': NULL}], g.l[i + 1:]) WHEN k = 5 THEN list_concat(g.l[:i], [{'name': fresh, 'state': NULL}], g.l[i + 2:])
            WHEN k = 2 THEN list_concat(g.l[:i], [{'name': v, 'state': g.l[i + 1].state}], g.l[i + 2:]) ELSE list_concat(g.l[:i], [{'name': g.l[i + 1].name, 'state': CASE WHEN k = 3 THEN v END}], g.l[i + 2:]) END, p.seq, good
        FROM go g JOIN p ON p.pathway_id = g.pathway_id AND p.step = g.step + 1,
        LATERAL (SELECT CASE WHEN odd OR k = 7 THEN false WHEN k = 6 THEN true WHEN k = 0 THEN i <= len(g.l) WHEN i >= len(g.l) THEN false WHEN k = 2 THEN g.l[i + 1].name IS NOT NULL WHEN k = 4 THEN g.l[i + 1].state IS NOT NULL ELSE true END AS good))"""


def replayed(t):
    rows, todo = (t.spark.sql(q, events=t.events) for q in (_ROWS, _PATCHES))
    return patches.apply_in_order(rows, todo, ["name", "state"])


query("P02_apply_patches", _REPLAY + """, last AS (SELECT pathway_id, arg_max(l, step) AS l FROM go GROUP BY 1)
    SELECT pathway_id, i - 1 AS pos, l[i].name AS name, l[i].state AS state FROM (SELECT pathway_id, l, unnest(range(1, len(l) + 1)) AS i FROM last)""")(lambda t: replayed(t)[0])
query("P02_patch_report", _REPLAY + "SELECT pathway_id, seq, ok AS applied FROM go WHERE seq IS NOT NULL")(lambda t: replayed(t)[1].select("pathway_id", "seq", "applied"))


# elements of list-valued fields: one row a user, its events' types as the list, patches to elements and to the whole
_SIDES = "SELECT user_id AS pathway_id, 0 AS pos, transform(array_sort(collect_list(struct(event_id, event_type))), x -> x.event_type) AS inputs FROM {events} GROUP BY user_id"
_SIDE_PATCHES = """SELECT user_id AS pathway_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'replace' WHEN 3 THEN 'add' ELSE if(event_id % 35 = 4, 'replace', 'remove') END AS op,
    concat('/0/inputs', CASE WHEN event_id % 35 = 4 THEN '' WHEN event_id % 5 = 3 THEN '/-' ELSE concat('/', event_id % 11) END) AS path, CASE WHEN event_id % 35 = 4 THEN concat('["a', event_id, '", "b"]') ELSE concat('v', event_id) END AS value FROM {events}"""
query("P02_nested_lists", """WITH RECURSIVE r AS (SELECT user_id AS pathway_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY 1),
    p AS (SELECT user_id AS pathway_id, event_id % 5 AS k, event_id % 35 = 4 AS whole, event_id % 11 AS i, concat('v', event_id) AS v, concat('a', event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
    go(pathway_id, step, l) AS (SELECT pathway_id, CAST(0 AS BIGINT), l FROM r
      UNION ALL SELECT g.pathway_id, p.step, CASE WHEN whole THEN [a, 'b'] WHEN k = 3 THEN list_append(g.l, v) WHEN k = 0 AND i <= len(g.l) THEN list_concat(g.l[:i], [v], g.l[i + 1:]) WHEN k = 0 OR i >= len(g.l) THEN g.l
            WHEN k = 2 THEN list_concat(g.l[:i], [v], g.l[i + 2:]) ELSE list_concat(g.l[:i], g.l[i + 2:]) END FROM go g JOIN p ON p.pathway_id = g.pathway_id AND p.step = g.step + 1)
    SELECT pathway_id, array_to_string(arg_max(l, step), ',') AS inputs FROM go GROUP BY 1""")(
    lambda t: patches.apply_in_order(t.spark.sql(_SIDES, events=t.events), t.spark.sql(_SIDE_PATCHES, events=t.events), [], ["inputs"])[0].select("pathway_id", F.array_join("inputs", ",").alias("inputs"))
)
