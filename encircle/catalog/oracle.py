"""Equivalent SQL for the queries, written independently of the Spark code.

The greedy cover is a recursive query over "atoms", the points held by the same circles.
"""

from __future__ import annotations

_POINTS = """
select o_orderkey as point_id,
  least(cast(1000 as double), greatest(cast(0 as double),
    cast((c_nationkey*379+83)%1000 as double)
    + cast(cents%16001 + (o_orderkey*7919)%16001 - 16000 as double)/cast(100 as double))) as x,
  least(cast(1000 as double), greatest(cast(0 as double),
    cast((c_nationkey*617+211)%1000 as double)
    + cast((cents*31)%16001 + (o_orderkey*104729)%16001 - 16000 as double)/cast(100 as double))) as y
from (select o_orderkey, o_custkey, cast(round(o_totalprice*100) as bigint) as cents from orders) o
join customer on o_custkey = c_custkey
"""

_CIRCLES = """
select p_partkey as circle_id,
  cast((p_partkey*7919)%100000 as double)/cast(100 as double) as cx,
  cast((p_partkey*104729+31337)%100000 as double)/cast(100 as double) as cy,
  cast(300+14*p_size as double)/cast(10 as double) as r
from part
"""

_SELECTED = """
select c.* from circles c join part on circle_id = p_partkey
where p_type = 'ECONOMY' and p_size >= 45
"""

_BASE = f"with points as materialized ({_POINTS}), circles as materialized ({_CIRCLES})"
_SETS = f"{_BASE}, selected as materialized ({_SELECTED})"
_HIT = "(x-cx)*(x-cx)+(y-cy)*(y-cy) <= r*r"
_PAIRS = f"pairs as materialized (select point_id, circle_id from points join circles on {_HIT})"
_COVERED = f"select distinct point_id from points join selected on {_HIT}"
_GAINS = f"""
{_SETS}, open as materialized (select * from points where point_id not in ({_COVERED})),
counted as (select circle_id, count(*) n from open join circles on {_HIT} group by circle_id),
gains as (select c.circle_id, coalesce(n, 0) as gain from circles c left join counted n
  on n.circle_id = c.circle_id where c.circle_id not in (select circle_id from selected))
"""
_WIDEST = """(select * from circles where circle_id not in (select circle_id from selected)
  order by r desc, circle_id limit 1)"""
_THRESHOLD = "(select count(*) from orders) / 100.0::double"


def _greedy(guesses: str) -> str:
    """Recursive CTE ``s`` of picks for a table of ``j, tau`` named by the argument."""
    return f"""
with recursive
points as materialized ({_POINTS}), circles as materialized ({_CIRCLES}), {_PAIRS},
atoms as materialized (select cs, count(*) w from
  (select point_id, list(circle_id order by circle_id) cs from pairs group by point_id) group by cs),
fe as (select coalesce(max(cov), 0) fe from (select count(*) cov from pairs group by circle_id)),
guesses as materialized ({guesses}),
s as (
  select j, tau, cast(0 as bigint) step, cast(-1 as bigint) circle_id, cast(0 as bigint) gain,
    cast([] as bigint[]) sel from guesses
  union all
  select j, tau, step, circle_id, gain, sel from (
    select j, tau, step+1 step, cid circle_id, cast(sum(w) as bigint) gain,
      list_append(any_value(sel), cid) sel, row_number() over (partition by j order by cid) rn
    from (select s.j, s.tau, s.step, s.sel, s.circle_id lastc, a.w, unnest(a.cs) cid
          from s join atoms a on not list_has_any(a.cs, s.sel) where s.step < 10) u
    where cid > lastc group by j, tau, step, cid having sum(w) >= tau) z where rn = 1),
cov as (select j, sum(gain) c from s group by j),
cut as (select coalesce(min(j), 999) jmax from cov where c = (select count(*) from points)),
trace as (select cast(j as int) guess_j, tau, cast(step as int) step, circle_id, gain,
    cast(sum(gain) over (partition by j order by step) as bigint) coverage
  from s, cut where step > 0 and j <= jmax),
best as (select guess_j, count(*) selected, cast(sum(gain) as bigint) coverage
  from trace group by guess_j order by coverage desc, guess_j limit 1)
"""


_LADDER = """select j, pow(cast(1.2 as double), j)*fe/cast(20 as double) as tau
  from fe, (select unnest(range(0, 14)) j) where fe > 0"""
_GREEDY = _greedy(_LADDER)
_GREEDY_ONE = _greedy(f"select 0 as j, {_THRESHOLD} as tau")


def _uniform(text: str, start: int = 1) -> str:
    return (
        f"(cast(cast('0x' || substr(md5({text}), {start}, 13) as bigint) as double)"
        " / cast(4503599627370496 as double))"
    )


def _normal(text: str, wave: str) -> str:
    whole = f"cast(cast('0x' || substr(md5({text}), 1, 13) as bigint) as double)"
    return (
        f"sqrt(-2.0::double * ln(({whole} + 1.0::double) / 4503599627370497.0::double))"
        f" * {wave}(6.283185307179586::double * {_uniform(text, 14)})"
    )


def _placed(axis: str, start: int, wave: str) -> str:
    centre = f"1000.0::double * {_uniform('''concat('centre42:', cluster)''', start)}"
    offset = f"80.0::double * {_normal('''concat('point42:', i)''', wave)}"
    return (
        f"round(greatest(0.0::double, least(1000.0::double, {centre} + {offset})), 6) as {axis}"
    )



_CELL_X = "least(cast(trunc(x/cast(20 as double)) as int), 49)"
_CELL_Y = "least(cast(trunc(y/cast(20 as double)) as int), 49)"
_DRAW = _uniform("concat('sample42:', point_id)")
_STRATIFIED = f"""select cell_x, cell_y, point_id, x, y from (
  select *, row_number() over (partition by cell_x, cell_y
    order by md5(cast(point_id as varchar)), point_id) rn
  from (select *, {_CELL_X} cell_x, {_CELL_Y} cell_y from points) p) w where rn <= 10"""
_DISPLAY = f"""select point_id, x, y from points, (select count(*) n from points)
  where n <= 5000 or (n <= 50000 and {_DRAW} < 5000 / cast(n as double))
  union all select point_id, x, y from ({_STRATIFIED}), (select count(*) n from points)
  where n > 50000"""

_RUN_EVENTS = """
select run_id, seq, type,
  case when type = 'STATUS' then 'status ' || number end as message,
  case when type in ('STATUS', 'INIT') then cast(number as int) end as total_guesses,
  case when type = 'START_GUESS' then cast(number % 14 as int) end as value,
  case when type in ('START_GUESS', 'CIRCLE_ADDED') then amount end as threshold,
  case when type = 'CIRCLE_ADDED' then number end as gain,
  case when type in ('CIRCLE_ADDED', 'FINAL_SOLUTION') then cents end as coverage,
  case when type = 'CIRCLE_ADDED' then cast(number % 10 + 1 as int) end as step,
  case when type = 'FINAL_SOLUTION' then cast(number % 14 as int) end as best_guess,
  case when type = 'FINAL_SOLUTION' then cast(number % 10 + 1 as int) end as n_selected,
  case when type = 'FINAL_SOLUTION' and cents + number > 0 then
    round(cast(cents as double) * 100.0::double / cast(cents + number as double), 1) end
    as coverage_percentage
from (select *, case event_type when 'signup' then 'INIT' when 'view' then 'START_GUESS'
    when 'click' then 'CIRCLE_ADDED' when 'purchase' then 'FINAL_SOLUTION'
    else case when number % 2 = 0 then 'STATUS' else 'FINISHED' end end as type
  from (select user_id run_id, event_id seq, event_type, value amount,
      cast(regexp_extract(props, '[0-9]+') as bigint) number,
      cast(round(value*100) as bigint) cents from events))
"""

_SNAPSHOT = """
select run_id,
  arg_max(coalesce(step, n_selected), seq) filter (coalesce(step, n_selected) is not null) as k,
  arg_max(coverage, seq) filter (coverage is not null) as coverage,
  arg_max(value, seq) filter (value is not null) as guess_j,
  arg_max(threshold, seq) filter (threshold is not null) as threshold,
  arg_max(total_guesses, seq) filter (total_guesses is not null) as total_guesses,
  arg_max(text, seq) filter (text is not null) as status_text,
  arg_max(best_guess, seq) filter (best_guess is not null) as best_guess,
  arg_max(coverage_percentage, seq) filter (coverage_percentage is not null) as coverage_percentage,
  max(seq) filter (type = 'INIT') as last_init,
  max(seq) filter (type = 'FINAL_SOLUTION') as last_final,
  max(seq) filter (type = 'FINISHED') as last_finished,
  max(seq) as last_seq
from (select *, case type when 'STATUS' then message when 'START_GUESS' then 'GUESS ' || (value + 1)
    when 'FINAL_SOLUTION' then 'BEST: Guess ' || (best_guess + 1) || ' | ' || n_selected
      || ' circles → ' || coverage || ' pts'
    when 'FINISHED' then 'DONE' end as text from run_events)
group by run_id
"""

_WITH_EVENTS = f"with run_events as materialized ({_RUN_EVENTS})"

_WORKERS = """
select o_orderkey as snapshot_id, cast(i as int) as position,
  case when (o_orderkey+i)%5 = 0 then '' else concat('worker-', o_orderkey, '-', i) end as id,
  concat('10.0.', o_orderkey%256, '.', i) as host,
  cast(case when (o_orderkey+i)%7 = 0 then 0 else 7000+i end as int) as port,
  cast((o_orderkey+i)%9 as int) as cores,
  cast((o_orderkey*3+i)%9 as int) as coresused,
  cast(((o_orderkey+i)%6)*512 as int) as memory,
  cast((o_orderkey*17+i)%2048 as int) as memoryused,
  case (o_orderkey+i)%4 when 0 then 'DEAD' when 3 then 'UNKNOWN' else 'ALIVE' end as state
from orders, (select unnest(range(0, 3)) i) where i < o_orderkey%4 and o_orderkey%17 <> 0
"""


def _percent(used: str, capacity: str) -> str:
    return (
        f"case when {capacity} > 0 then "
        f"round(cast({used} as double) / cast({capacity} as double) * 100.0::double, 1) "
        "else 0.0::double end"
    )


def _band(percent: str) -> str:
    return f"case when {percent} > 80 then 'danger' when {percent} > 50 then 'warning' else 'success' end"


_APPS = """
select o_orderkey as snapshot_id, cast(i as int) as position,
  case when (o_orderkey+i)%3 = 0 then 'report' else 'cover-run' end as name,
  case when (o_orderkey+i)%8 = 0 then null else cast((o_orderkey+i)%9 as int) end as cores,
  case when (o_orderkey+i)%2 = 0 then 'RUNNING' else 'WAITING' end as state,
  (1700001000000 - 1700000000000 - (o_orderkey*7919 + i*61000)%900000) // 1000 as seconds
from orders, (select unnest(range(0, 2)) i) where i < (o_orderkey+1)%3
"""

ORACLE_SQL: dict[str, str] = {
    "points_scan": f"select * from ({_POINTS})",
    "circles_scan": f"select * from ({_CIRCLES})",
    "circle_ordinal": f"""select row_number() over (order by cx, cy, r) - 1 as circle_id, cx, cy, r
        from ({_CIRCLES})""",
    "gen_points": f"""select i as point_id, cluster, {_placed('x', 1, 'cos')},
        {_placed('y', 14, 'sin')}
        from (select o_orderkey i, cast(c_nationkey as int) cluster
              from orders join customer on o_custkey = c_custkey)""",
    "gen_circles": f"""select i as circle_id,
        round(1000.0::double * {_uniform("concat('circle43:', i)")}, 6) as cx,
        round(1000.0::double * {_uniform("concat('circle43:', i)", 14)}, 6) as cy,
        round(30.0::double + 70.0::double * {_uniform("concat('radius43:', i)")}, 6) as r
        from (select p_partkey i from part)""",
    "gen_preset_counts": f"""select preset, cluster, count(*) as points,
          count(*) filter (x in (0, 1000) or y in (0, 1000)) as at_border
        from (select preset, cluster, {_placed('x', 1, 'cos')}, {_placed('y', 14, 'sin')}
          from (select preset, o_orderkey i, cast(o_custkey % n_clusters as int) cluster from orders,
            (values ('small', 8), ('medium', 20), ('large', 50)) p(preset, n_clusters)))
        group by preset, cluster""",
    "trace_json": f"""{_GREEDY}, shown as (select count(*) n_shown from ({_DISPLAY})),
        total as (select count(*) n from points),
        blank as (select null::varchar message, null::int total_guesses, null::int n_shown,
          null::bigint n_circles, null::double sampling_percentage, null::int as value,
          null::double threshold, null::double cx, null::double cy, null::double r,
          null::bigint gain, null::bigint coverage, null::int step, null::int best_guess,
          null::int n_selected, null::bigint total_points, null::double coverage_percentage)
        select 0::bigint seq, 'INIT' as type, * replace (14 as total_guesses,
            (select n_shown::int from shown) as n_shown,
            (select count(*) from circles) as n_circles,
            (select case when n > n_shown then round(n_shown * 100.0::double / n, 1) end
              from shown, total) as sampling_percentage) from blank
        union all select 1, 'STATUS', * replace
            ('Calculating max single coverage f(e)...' as message) from blank
        union all select 2, 'STATUS', * replace
            ('Starting guesses...' as message, 14 as total_guesses) from blank
        union all select 3 + j*11, 'START_GUESS', blank.* replace
            (j::int as value, round(tau, 6) as threshold)
            from blank, guesses, cut where j <= jmax
        union all select 3 + guess_j*11 + t.step, 'CIRCLE_ADDED', blank.* replace
            (round(tau, 6) as threshold, c.cx as cx, c.cy as cy, c.r as r, t.gain as gain,
             t.coverage as coverage, t.step as step)
            from blank, trace t join circles c on c.circle_id = t.circle_id
        union all select 157, 'FINAL_SOLUTION', blank.* replace
            (b.coverage as coverage, b.guess_j as best_guess, b.selected::int as n_selected,
             n as total_points, round(b.coverage * 100.0::double / n, 1) as coverage_percentage)
            from blank, best b, total
        union all select 158, 'FINISHED', * from blank""",
    "run_summary": f"""{_GREEDY} select guess_j, selected, coverage, n as total_points,
        case when n > 0 then round(coverage * 100.0::double / n, 1) else 0.0::double end
          as coverage_percentage from best, (select count(*) n from points)""",
    "in_circle_flag": f"""select point_id,
        (x-500.0::double)*(x-500.0::double)+(y-500.0::double)*(y-500.0::double)
          <= 250.0::double*250.0::double as inside from ({_POINTS})""",
    "clamp_points": f"""select point_id, greatest(200.0::double, least(1000.0::double, x)) as x,
        greatest(0.0::double, least(750.0::double, y)) as y from ({_POINTS})""",
    "grid_cells": f"""select point_id, {_CELL_X} as cell_x, {_CELL_Y} as cell_y
        from ({_POINTS})""",
    "candidates_above": f"{_GAINS} select circle_id, gain from gains where gain >= {_THRESHOLD}",
    "remaining_circles": f"""{_SETS} select * from circles
        where circle_id not in (select circle_id from selected)""",
    "threshold_ladder": f"""{_BASE}, {_PAIRS}, fe as (select max(n) fe from
          (select count(*) n from pairs group by circle_id))
        select cast(j as int) as guess_j, tau from ({_LADDER})""",
    "coverage_pairs": f"{_BASE}, {_PAIRS} select point_id, circle_id from pairs",
    "covered_points": f"{_SETS} select * from points where point_id in ({_COVERED})",
    "uncovered_points": f"{_SETS} select * from points where point_id not in ({_COVERED})",
    "point_count": f"select count(*) as points from ({_POINTS})",
    "set_coverage": f"{_SETS} select count(*) as coverage from ({_COVERED})",
    "coverage_by_circle": f"""{_BASE}, {_PAIRS} select c.circle_id, count(point_id) as coverage
        from circles c left join pairs p on p.circle_id = c.circle_id group by c.circle_id""",
    "best_single": f"""{_BASE}, {_PAIRS} select c.circle_id, count(point_id) as coverage
        from circles c left join pairs p on p.circle_id = c.circle_id group by c.circle_id
        order by coverage desc, circle_id limit 1""",
    "marginal_gain_one": f"""{_SETS} select count(*) as gain from points join {_WIDEST} on {_HIT}
        where point_id not in ({_COVERED})""",
    "marginal_gains": f"{_GAINS} select circle_id, gain from gains",
    "first_candidate": f"""{_GAINS} select circle_id, gain from gains where gain >= {_THRESHOLD}
        order by circle_id limit 1""",
    "set_union_coverage": f"""{_SETS}, grown as (select * from selected union all
          select * from {_WIDEST})
        select count(distinct point_id) as coverage from points join grown on {_HIT}""",
    "cell_density": f"""select {_CELL_X} as cell_x, {_CELL_Y} as cell_y, count(*) as points
        from ({_POINTS}) group by 1, 2""",
    "greedy_single_tau": f"{_GREEDY_ONE} select step, circle_id, gain, coverage from trace",
    "greedy_trace": f"""{_GREEDY} select guess_j, round(tau, 6) as tau, step, circle_id, gain
        from trace""",
    "best_guess": f"{_GREEDY} select guess_j, selected, coverage from best",
    "greedy_solution": f"""{_GREEDY} select t.guess_j, step, t.circle_id, cx, cy, r, gain,
        t.coverage from trace t join best b on b.guess_j = t.guess_j
        join circles c on c.circle_id = t.circle_id""",
    "trace_running_coverage": f"""{_GREEDY} select guess_j, step, circle_id, gain,
        coverage as running_coverage from trace""",
    "uniform_sample": f"""select point_id, x, y from ({_POINTS}), (select count(*) n from orders)
        where {_DRAW} < (n // 10) / cast(n as double)""",
    "stratified_sample": f"""with points as ({_POINTS})
        select cell_x, cell_y, point_id from ({_STRATIFIED})""",
    "display_sample": f"with points as ({_POINTS}) {_DISPLAY}",
    "sampling_info": f"""with points as ({_POINTS}),
        d as (select count(*) displayed from ({_DISPLAY})), t as (select count(*) total from points)
        select displayed, total, total > displayed as is_sampled,
          case when total > displayed then round(displayed * 100.0::double / total, 1)
            else 100.0::double end as percentage,
          case when total > displayed then
            format('{{:,}}', total) || ' (' || format('{{:,}}', displayed) || ' shown)'
            else format('{{:,}}', total) end as points_label from d, t""",
    "segment_by_marker": """select user_id, event_id, event_type,
        cast(count(*) filter (event_type = 'signup')
          over (partition by user_id order by event_id) as bigint) as segment from events""",
    "latest_run": """select e.user_id, event_id, event_type, value from events e left join
        (select user_id, max(event_id) m from events where event_type = 'signup' group by user_id) s
        on s.user_id = e.user_id where event_id >= coalesce(m, -1)""",
    "guess_series": f"""{_WITH_EVENTS}, numbered as (select *,
          count(*) filter (type in ('INIT', 'START_GUESS'))
            over (partition by run_id order by seq) as series from run_events)
        select run_id, series, seq, cast(coalesce(step, position) as bigint) as step, position,
          gain, threshold, coverage
        from (select *, row_number() over (partition by run_id, series order by seq) as position
          from numbered where type = 'CIRCLE_ADDED')""",
    "run_setup": f"""with points as ({_POINTS}), circles as ({_CIRCLES}),
        d as (select count(*) displayed from ({_DISPLAY})), t as (select count(*) total from points)
        select 0::bigint as run_id, (select count(*) from circles) as n_circles, 10 as k,
          0.2::double as epsilon, 14 as total_guesses, 0.0::double as min_x, 0.0::double as min_y,
          1000.0::double as max_x, 1000.0::double as max_y, total > displayed as is_sampled,
          displayed, total,
          case when total > displayed then round(displayed * 100.0::double / total, 1)
            else 100.0::double end as percentage,
          case when total > displayed then
            format('{{:,}}', total) || ' (' || format('{{:,}}', displayed) || ' shown)'
            else format('{{:,}}', total) end as points_label from d, t""",
    "run_snapshot": f"{_WITH_EVENTS} {_SNAPSHOT}",
    "stream_snapshot": f"{_WITH_EVENTS} {_SNAPSHOT}",
    "run_display": f"""{_WITH_EVENTS}, flags as (select *,
          coalesce(last_finished > coalesce(last_init, -1), false) as finished,
          coalesce(last_final > coalesce(last_init, -1), false) as has_final from ({_SNAPSHOT}))
        select run_id,
          cast(coalesce(case when has_final then best_guess end, guess_j) + 1 as int)
            as guess_number,
          case when threshold is not null then printf('%.2f', threshold) end as threshold_text,
          coverage || case when has_final then ' (' ||
              regexp_replace(printf('%.1f', coverage_percentage), '\\.0$', '') || '%)' else '' end
            as coverage_text,
          case when has_final then 'FINAL SOLUTION: ' ||
              regexp_replace(printf('%.1f', coverage_percentage), '\\.0$', '') || '% Coverage'
            when finished then 'OPTIMIZATION COMPLETE' else 'SYSTEM CONNECTED' end as headline,
          case when finished then 'DONE' when last_init is not null then 'RUNNING' else 'IDLE' end
            as state from flags""",
    "worker_rows": _WORKERS,
    "worker_utilisation": f"""select snapshot_id, position, host, cpu_percent, memory_percent,
          {_band('cpu_percent')} as cpu_band, {_band('memory_percent')} as memory_band,
          state = 'ALIVE' as alive
        from (select *, {_percent('coresused', 'cores')} as cpu_percent,
          {_percent('memoryused', 'memory')} as memory_percent from ({_WORKERS}))""",
    "cluster_totals": """select o_orderkey as snapshot_id,
          case when o_orderkey%11 = 0 then 'UNKNOWN' else 'ALIVE' end as status,
          cast(case when o_orderkey%13 = 0 then 0 else o_orderkey%97 end as int) as cores,
          cast(o_orderkey%31 as int) as coresused, cast(o_orderkey%65536 as int) as memory,
          cast(case when o_orderkey%10 = 3 then 0 else o_orderkey%4096 end as int) as memoryused,
          cast(case when o_orderkey%17 = 0 then 0 else o_orderkey%4 end as int) as n_workers,
          cast((o_orderkey+1)%3 as int) as n_apps,
          cast(case when o_orderkey%19 = 0 then 0 else least(o_orderkey%5, 4) end as int) as n_completed
        from orders""",
    "cluster_headline": f"""with mine as (select snapshot_id, min_by(state, position) as my_state
          from ({_APPS}) where name = 'cover-run' group by snapshot_id)
        select o_orderkey as snapshot_id, my_state,
          case my_state when 'WAITING' then 'WAITING FOR RESOURCES...'
            when 'RUNNING' then 'CLUSTER RUNNING' end as headline
        from orders left join mine on snapshot_id = o_orderkey""",
    "active_apps": f"""select snapshot_id, position, name, cores, state,
          case when seconds >= 60 then concat(seconds // 60, 'm ', seconds % 60, 's')
            else concat(seconds, 's') end as elapsed,
          coalesce(position = min(position) filter (name = 'cover-run')
            over (partition by snapshot_id), false) as is_mine
        from ({_APPS})""",
}
