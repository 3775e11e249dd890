"""Balanced partitions and schedules once more, in DuckDB's SQL: what the queries are held against.

A recursive query keeps each group's blocks as a sorted list of structs and folds the two most
uneven ones until one is left. Written for small tables, with lists in place of heaps and scans in
place of bisection.
"""

from __future__ import annotations


def _fold(a: str, b: str) -> str:
    """The i-th smallest part of a joins the i-th largest of b."""
    return f"list_sort(list_transform(range(1, k + 1), lambda i: {{'sum': ({a})[i].sum + ({b})[k + 1 - i].sum, 'at': i, 'ids': list_concat(({a})[i].ids, ({b})[k + 1 - i].ids)}}))"


def _melded(a: str, b: str, threshold: str) -> str:
    """Parts of a (smallest first) and of b (largest first) in pairs that stay apart by the threshold.

    The state is the parts left on either side and the pairs made; a step takes the first of each
    side and the first partners of equal place that make the pairs differ by the threshold.
    """
    joined = lambda x, y: f"{{'sum': {x}.sum + {y}.sum, 'at': CAST(0 AS BIGINT), 'ids': list_concat({x}.ids, {y}.ids)}}"
    place = f"coalesce(list_filter(range(2, len(s.low) + 1), lambda j: s.low[j].sum - s.high[j].sum >= {threshold} - s.high[1].sum + s.low[1].sum)[1], len(s.low))"
    rest = lambda side: f"list_concat(s.{side}[2:r - 1], s.{side}[r + 1:])"
    step = f"""list_transform([{place}], lambda r: {{'low': {rest("low")}, 'high': {rest("high")},
      'made': list_concat(s.made, [{joined("s.low[r]", "s.high[1]")}, {joined("s.low[1]", "s.high[r]")}])}})[1]"""
    last = f"{{'low': s.low[2:], 'high': s.high[2:], 'made': list_append(s.made, {joined('s.low[1]', 's.high[1]')})}}"
    start = f"{{'low': {a}, 'high': list_reverse({b}), 'made': ({a})[1:0]}}"
    pairs = f"list_reduce(list_transform(range(0, k + 1), lambda i: {start}), lambda s, t: CASE WHEN len(s.low) = 0 THEN s WHEN len(s.low) = 1 THEN {last} ELSE {step} END).made"
    return f"list_transform([{pairs}], lambda m: list_sort(list_transform(range(1, k + 1), lambda i: {{'sum': m[i].sum, 'at': i, 'ids': m[i].ids}})))[1]"


def partition_ctes(name: str, items: str, meld: bool = True) -> str:
    """CTEs that partition the rows of items (g, k, ord, key, id) within each g; the last one, `name`,
    has g, place (from 0), total, ids (a list) for each of its k parts. ord counts from 0, in ascending
    order of the keys; each g has a multiple of k rows."""
    other = "CASE WHEN len(heap) > 2 AND heap[2].spread + heap[3].spread < heap[1].spread THEN " + _melded("heap[2].parts", "heap[3].parts", "heap[1].spread") + " ELSE heap[2].parts END" if meld else "heap[2].parts"
    used = "CASE WHEN len(heap) > 2 AND heap[2].spread + heap[3].spread < heap[1].spread THEN 3 ELSE 2 END" if meld else "2"
    return f"""
{name}_blocks AS (
  SELECT g, k, ord // k AS block, list({{'sum': CAST(key AS HUGEINT), 'at': ord % k + 1, 'ids': [id]}} ORDER BY ord) AS parts FROM {items} GROUP BY g, k, ord // k
), {name}_start AS (
  SELECT g, k, count(*) AS born, list_reverse_sort(list({{'spread': parts[k].sum - parts[1].sum, 'age': -block, 'parts': parts}})) AS heap FROM {name}_blocks GROUP BY g, k
), {name}_rounds AS (
  SELECT g, k, born, heap FROM {name}_start
  UNION ALL
  SELECT g, k, born + 1, list_reverse_sort(list_append(heap[used + 1:], {{'spread': folded[k].sum - folded[1].sum, 'age': -born, 'parts': folded}}))
  FROM (SELECT g, k, born, heap, used, {_fold("heap[1].parts", "other")} AS folded FROM (SELECT g, k, born, heap, {used} AS used, {other} AS other FROM {name}_rounds WHERE len(heap) > 1))
), {name} AS (
  SELECT g, place - 1 AS place, CAST(heap[1].parts[place].sum AS BIGINT) AS total, heap[1].parts[place].ids AS ids
  FROM {name}_rounds, unnest(range(1, k + 1)) AS t(place) WHERE len(heap) = 1
)"""


def schedule_ctes(samples: str, cost: str, stable: bool, policy: str, ranks: int, global_batch: int, micro_batch: int) -> str:
    """CTEs from a table of pos, idx and size to the schedule `s` (step, rank, micro, slot, pos, idx, size, cost); cost: SQL of size."""
    first = "cost" if policy == "fast" else "size"
    second = "size" if policy == "mem" else "cost"
    each, n = f"({global_batch} // {ranks})", f"(SELECT count(*) FROM {samples})"
    # the unit that is regrouped: a step, or all whole steps (0) and what is left (1)
    unit = f"pos // {global_batch}" if stable else f"CASE WHEN pos < {n} // {global_batch} * {global_batch} THEN 0 ELSE 1 END"
    parts = f"{ranks}" if stable else f"CASE WHEN g = 0 THEN count(*) OVER (PARTITION BY g) // {each} ELSE {ranks} END"
    if stable:
        placed = "SELECT g AS step, place AS rank, ids FROM deal"
        order = "list_position(ids, id)"
    else:
        by = "size" if policy == "mem" else "cost"
        placed = f"""SELECT CASE WHEN g = 0 THEN 0 ELSE {n} // {global_batch} END + number // {ranks} AS step, number % {ranks} AS rank, ids
  FROM (SELECT d.g, d.ids, row_number() OVER (PARTITION BY d.g ORDER BY t.total, d.place) - 1 AS number
    FROM deal d JOIN (SELECT u.g, u.place, sum(c.{by}) AS total FROM (SELECT g, place, unnest(ids) AS id FROM deal) u JOIN costed c ON c.pos = u.id GROUP BY u.g, u.place) t ON d.g = t.g AND d.place = t.place)"""
        order = "size, idx, pos"
    ranked = "micro_place" if policy != "mem" else "row_number() OVER (PARTITION BY g ORDER BY cost_total, micro_place) - 1"
    return f"""
costed AS (
  SELECT pos, idx, size, {cost} AS cost, {unit} AS g FROM {samples}
), dealt_items AS (
  SELECT g, CAST({parts} AS BIGINT) AS k, row_number() OVER (PARTITION BY g ORDER BY {first}, size, idx, pos) - 1 AS ord, {first} AS key, pos AS id FROM costed
), {partition_ctes("deal", "dealt_items")}, placed AS (
  {placed}
), own AS (
  SELECT step, rank, pos, idx, size, cost, row_number() OVER (PARTITION BY step, rank ORDER BY {second}, {order}) - 1 AS o, count(*) OVER (PARTITION BY step, rank) AS b
  FROM (SELECT step, rank, ids, unnest(ids) AS id FROM placed) JOIN costed ON pos = id
), cut_items AS (
  SELECT step * {ranks} + rank AS g, CAST(b // {micro_batch} AS BIGINT) AS k, o AS ord, {second} AS key, pos AS id FROM own WHERE o < b // {micro_batch} * {micro_batch}
), {partition_ctes("cut", "cut_items")}, cut_costs AS (
  SELECT g, place AS micro_place, ids, (SELECT sum(cost) FROM own WHERE list_contains(ids, pos)) AS cost_total FROM cut
), micro_batches AS (
  SELECT g, {ranked} AS micro, ids FROM cut_costs
), s AS (
  SELECT step, CAST(rank AS INTEGER) AS rank, CAST(micro AS INTEGER) AS micro, CAST(list_position(ids, pos) - 1 AS INTEGER) AS slot, pos, idx, size, cost
  FROM (SELECT g, micro, ids, unnest(ids) AS id FROM micro_batches) JOIN own ON pos = id
  UNION ALL
  SELECT step, CAST(rank AS INTEGER), CAST(b // {micro_batch} AS INTEGER), CAST(o - b // {micro_batch} * {micro_batch} AS INTEGER), pos, idx, size, cost FROM own WHERE o >= b // {micro_batch} * {micro_batch}
)"""
