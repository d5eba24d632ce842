"""What the registered queries compute, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from ..functions import errors as E
from ..functions import normalize as N
from ..functions import text as X
from ..sources import views as V

_SEVERITY = "case error_type " + " ".join(f"when '{k}' then {s}" for k, (s, _) in E.CATEGORIES.items()) + " end"
_any = lambda parts: "(" + " or ".join(f"contains(lower(message), '{p}')" for p in parts) + ")"
_STEP = _any([p for ps in E.CLASSES.values() for p in ps])
_STEP_CLASS = "case " + " ".join(f"when {_any(ps)} then '{k}'" for k, ps in E.CLASSES.items()) + " else 'error' end"
_ERROR = _any(["error", "fail", "exception"])
_TRACE_CLASS = (
    "case when contains(lower(message), 'timeout') then 'timeout' when contains(lower(message), 'connection') then 'connection' when "
    "contains(lower(message), 'exception') then 'exception' else 'error' end"
)
_groups = lambda ps, flags="": "coalesce(" + ", ".join(f"nullif(regexp_extract(message, '{flags}{p}', 1), '')" for p in ps) + ")"
_EXCEPTION = _groups(E.EXCEPTIONS)
_PLACE = "case " + " ".join(f"when regexp_matches(message, '{p}') then regexp_extract(message, '{p}', 1) || ':' || regexp_extract(message, '{p}', 2)" for p in E.PLACES) + " end"
_TRACEBACK = f"(regexp_matches(message, '(?i){E.TRACE_HEADER}') or " + " or ".join(f"regexp_matches(message, '(?m){p}')" for p in E.TRACE_LINES) + ")"
_stamp = lambda c: f"strftime(make_timestamp({X.duckdb_micros(c)}), '%Y-%m-%d %H:%M:%S')"
_tokens = lambda c: (
    f"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z ]+', ' ', 'g'), ' +'), lambda x: "
    f"length(x) >= 3)))"
)



def _iso(column: str) -> str:
    us = X.duckdb_micros(column)
    return (
        f"case when {us} % 1000000 = 0 then strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') else strftime(make_timestamp({us}), "
        f"'%Y-%m-%dT%H:%M:%S.%f') end"
    )


_clock = lambda c: f"substr(strftime(make_timestamp({X.duckdb_micros(c)}), '%H:%M:%S.%f'), 1, 12)"

L = f"l as ({V.logs_sql(False)})"
L2 = f"l2 as ({V.logs_sql(False, True)})"
M = f"m as ({V.methods_sql()})"
D = (
    f"d as (select *, {_SEVERITY} as severity, {_TRACEBACK} as has_traceback, {_EXCEPTION} as exception_type from (select *, "
    f"{E.duckdb_category('message')} as error_type from l) where error_type is not null)"
)
S = (
    f"n as (select *, {N.duckdb_normalized('message', 'mine')} as normalized from d), s as (select *, "
    f"{N.duckdb_signature('normalized', 'error_type', 'service', 'mine', 'exception_type')} as signature from n)"
)
S2 = (
    f"n2 as (select *, {_STEP_CLASS} as error_type, {_groups(E.TRACE_IDS, '(?i)')} as trace_id, "
    f"{N.duckdb_normalized('message', 'steps')} as normalized from l where {_STEP}), s2 as (select *, "
    f"{N.duckdb_signature('normalized', 'error_type', 'service', 'steps')} as signature from n2)"
)
S3 = (
    f"n3 as (select *, {_TRACE_CLASS} as error_type, {N.duckdb_normalized('message', 'trace')} as normalized from l where {_ERROR}), s3 "
    f"as (select *, {N.duckdb_signature('normalized', 'error_type', 'service', 'trace')} as signature from n3)"
)
NAMES = "names as (select service, key, max(rec_idx) as rec_idx from (select service, rec_idx, unnest([name, full_name]) as key from m) group by service, key)"
INTRA = (
    "ic as (select a.service || '::' || a.name as caller, a.service || '::' || b.name as callee from (select service, name, "
    "unnest(callee_names) as key from m) a join names using (service, key) join m b on b.service = a.service and b.rec_idx = "
    "names.rec_idx), ei as (select caller, callee, 'CALL' as kind from ic union all select callee, caller, 'RETURN' from ic)"
)
INTER = (
    "xw as (select service, rec_idx, name, key from (select service, rec_idx, name, unnest(callee_names) as key from m) where (service, "
    "key) not in (select service, key from names)), xd as (select w.service, w.rec_idx, w.name, w.key, min((n.service, n.rec_idx)) as t "
    "from xw w join names n on n.key = w.key and n.service <> w.service group by all), xc as (select d.service || '::' || d.name as "
    "caller, b.service || '::' || b.name as callee from xd d join m b on b.service = d.t[1] and b.rec_idx = d.t[2]), ex as (select "
    "caller, callee, 'CALL' as kind from xc union all select callee, caller, 'RETURN' from xc)"
)
ALL = "e as (select * from ei union all select * from ex)"
MATCH = (
    f"lt as (select *, {_tokens('message')} as tokens from l), ix as (select service, rec_idx, len(tokens) as n, unnest(tokens) as token "
    f"from m), both_ as (select row_id, service, t.rec_idx, t.n, len(tokens) as nt, count(*) as c from (select row_id, service, tokens, "
    f"unnest(tokens) as token from lt) a join ix t using (service, token) group by all), best as (select row_id, max_by((rec_idx, "
    f"c::double / (nt + n - c)), (c::double / (nt + n - c), -rec_idx)) as b from both_ group by row_id), ma as (select l.*, "
    f"coalesce(m.name, '<unknown>') as method, m.rec_idx, m.full_name, coalesce(b[2], 0.0)::double as score from l left join best using "
    f"(row_id) left join m on m.service = l.service and m.rec_idx = b[1])"
)
CALLS = (
    f"c as (select row_id, timestamp, service, method, service || '::' || method as qualified_name, {_ERROR} as is_error, message, "
    f"round(score, 4) as score from ma where method <> '<unknown>' and round(score, 4) > 0.01)"
)
ROOTS = "roots as (select service || '::' || name as root from m)"
EROOTS = "roots as (select distinct qualified_name as root from c where is_error)"
REACH = (
    "ce as (select distinct caller, callee from e where kind = 'CALL'), walk(root, method, d) as (select root, root, 0 from roots union "
    "select w.root, ce.callee, d + 1 from walk w join ce on ce.caller = w.method where d < {depth}), rc as (select root, method, "
    "min(d)::int as bfs_depth from walk group by all)"
)
_home = lambda c: f"split_part({c}, '::', 1)"
GRAPH = (
    f"cg as (select root, caller, callee, case when {_home('caller')} = {_home('root')} and {_home('callee')} = {_home('root')} then "
    f"'internal' when {_home('caller')} = {_home('root')} then 'outbound' else 'external_chain' end as class, bfs_depth as depth from rc "
    f"join (select caller, callee from e where kind = 'CALL') on caller = method where bfs_depth < {{depth}})"
)
PATHS = (
    "paths as (select root, count(*) as total_reachable, max(bfs_depth) as call_depth, list_sort(list_distinct(list(split_part(method, "
    "'::', 1)))) as services_involved from rc group by root), kinds as (select root, count_if(class = 'internal') as n_internal, "
    "count_if(class = 'outbound') as n_outbound, count_if(class = 'external_chain') as n_external_chain from cg group by root), cp as "
    "(select root, total_reachable, call_depth, services_involved, coalesce(n_internal, 0)::bigint as n_internal, coalesce(n_outbound, "
    "0)::bigint as n_outbound, coalesce(n_external_chain, 0)::bigint as n_external_chain from paths left join kinds using (root))"
)
EDGES = ", ".join((M, NAMES, INTRA, INTER, ALL))
TREE = (
    "nodes as (select 'n' || n_nationkey as node_id from nation), tedges as (select 'r' || n_regionkey as src, 'n' || n_nationkey as "
    "dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || "
    "o_orderkey from orders), sub(root, node_id) as (select node_id, node_id from nodes union select root, dst from sub join tedges on "
    "src = node_id)"
)


def _with(*parts: str) -> str:
    return "with recursive " + ", ".join(parts) + " "


def _matched(*parts: str) -> str:
    return _with(L, M, MATCH, *parts)


def _window(w: float) -> str:
    return (
        f"b as (select greatest(min(timestamp) filter (where is_error) - {w}, min(timestamp)) as start_ts, min(timestamp) filter (where "
        f"is_error) + {w} as end_ts from c), w as (select c.*, start_ts, end_ts from c, b where timestamp between start_ts and end_ts)"
    )


def _sessions(gap: float, table: str = "c") -> str:
    return (
        f"ses as (select *, sum(new) over (order by timestamp, row_id) - 1 as session from (select *, case when timestamp - lag(timestamp) "
        f"over (order by timestamp, row_id) <= {gap} then 0 else 1 end as new from {table}))"
    )


def _flows(gap: float, table: str = "c") -> str:
    """ses with `flow`: sessions in a row are one flow where the first call of a session is linked with a call before it."""
    return f"""{_sessions(gap, table)},
pr as (select caller, callee from e where kind = 'CALL' union select callee, caller from e where kind = 'CALL'),
near as (select caller as first, list(distinct callee) as linked from pr group by caller),
sx as (
  select session::bigint as session, members, linked
  from (select session, arg_min(qualified_name, (timestamp, row_id)) as first, list(distinct qualified_name) as members from ses group by session) left join near using (first)),
fold(session, flow, members) as (
  select session, 0::bigint, members from sx where session = 0
  union all
  select s.session, case when linked is null or not list_has_any(f.members, linked) then flow + 1 else flow end,
    case when linked is null or not list_has_any(f.members, linked) then s.members else list_distinct(list_concat(f.members, s.members)) end
  from fold f join sx s on s.session = f.session + 1),
fc as (select ses.* exclude (session), flow from ses join fold on fold.session = ses.session),
inner_ as (
  select distinct a.flow, a.qualified_name as caller, b.qualified_name as callee
  from fc a join fc b using (flow) where (a.qualified_name, b.qualified_name) in (select (caller, callee) from e where kind = 'CALL')),
ft as (
  select flow, count(*) as n_calls, list_sort(list_distinct(list(service))) as services_involved, min(timestamp) as start_time, max(timestamp) as end_time,
    max(timestamp) - min(timestamp) as duration, bool_or(is_error) as has_error, count_if(is_error) as error_count,
    coalesce(list(qualified_name order by timestamp, row_id) filter (where not is_callee), []) as root_methods,
    coalesce(list(qualified_name order by timestamp, row_id) filter (where not is_caller), []) as leaf_methods,
    'flow_' || case when flow < 10000 then lpad(flow::varchar, 4, '0') else flow::varchar end as flow_id
  from (
    select fc.*, (flow, qualified_name) in (select (flow, callee) from inner_) as is_callee, (flow, qualified_name) in (select (flow, caller) from inner_) as is_caller
    from fc) group by flow)"""


def _samples(keys: str, k: int, table: str) -> str:
    return (
        f"sm as (select {keys}, list(message order by row_id) as sample_messages from (select *, row_number() over (partition by {keys} "
        f"order by row_id) as nth from {table}) where nth <= {k} group by {keys})"
    )


def _patterns(keys: str, k: int) -> str:
    on = f"({keys})"
    template = (
        f"tp as (select {keys}, arg_min(normalized, (-n, first)) as message_template from (select {keys}, normalized, count(*) as n, "
        f"min(row_id) as first from (select *, row_number() over (partition by {keys} order by row_id) as nth from s) where nth <= {k} group "
        f"by {keys}, normalized) group by {keys})"
    )
    kind = "" if "error_type" in keys else "arg_min(error_type, row_id) as error_type, "
    base = (
        f"pb as (select {keys}, {kind}count(*) as count, list_sort(list_distinct(list(service))) as services_affected, min(timestamp) as "
        f"first_seen, max(timestamp) as last_seen, arg_min(message, row_id) as representative_message, bool_or(has_traceback) as "
        f"has_traceback, coalesce(list_sort(list_distinct(list(exception_type) filter (where exception_type is not null))), []) as "
        f"exception_types from s group by {keys})"
    )
    return _with(L, D, S, _samples(keys, k, "s"), template, base) + f"select * from pb join sm using {on} join tp using {on}"


def _step(table: str, ids: bool) -> str:
    more = "coalesce(list_sort(list_distinct(list(trace_id) filter (where trace_id is not null))), []) as trace_ids, " if ids else ""
    return (
        f"select signature, count, services, first_seen, last_seen, {'trace_ids, ' if ids else ''}error_type, normalized_message, "
        f"sample_messages as samples from (select signature, count(*) as count, list_sort(list_distinct(list(service))) as services, "
        f"min(timestamp) as first_seen, max(timestamp) as last_seen, {more}arg_min(error_type, row_id) as error_type, arg_min(normalized, "
        f"row_id) as normalized_message from {table} group by signature) join sm using (signature)"
    )


def _counts(key: str, table: str = "d") -> str:
    return (
        f"select {key}, count(*) as count, count(*) * 100.0::double / (select count(*) from {table}) as percent, min(row_id) as first_row "
        f"from {table} group by {key}"
    )


_PROBES = "p as (select row_id as probe_id, service, method, timestamp as at from c where is_error)"


def _evidence(w: float) -> str:
    return _matched(CALLS, L2, _PROBES) + (
        f"select probe_id, max((l2.timestamp, l2.row_id))[1] as evidence_ts, max((l2.timestamp, l2.row_id))[2] as evidence_row from p join "
        f"l2 on l2.service = p.service and l2.timestamp < p.at and l2.timestamp >= p.at - {w} and contains(l2.message, p.method) group by probe_id"
    )


_E = ", ".join((NAMES, INTRA, INTER, ALL))
#: Lines of stack traces: `open` where a header is behind, with no line since that ends a trace.
_LINES = rf"""tl as (
  select row_id, i, line, regexp_matches(line, '(?i){E.TRACE_HEADER}') as header,
    regexp_matches(line, '^(?:File\s+"[^"]+",\s+line\s+\d+|at\s+\w+)') as within,
    contains(line, ':') and (contains(line, 'Exception') or contains(line, 'Error')) as ends
  from (
    select row_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') as line
    from (select row_id, unnest(string_split(message, chr(10))) as x, generate_subscripts(string_split(message, chr(10)), 1) as i from l where {_TRACEBACK}))
  where line <> ''),
to_ as (
  select *, max(case when header then i end) over before as h, max(case when ends and not within and not header then i end) over before as x
  from tl window before as (partition by row_id order by i rows between unbounded preceding and 1 preceding)),
tk as (
  select row_id, line, row_number() over (partition by row_id order by i) - 1 as nth
  from to_ where header or (h is not null and coalesce(x, -1) < h and (within or ends))),
lines as (select row_id, list(line order by nth) as traceback_lines from tk where nth < {E.MOST_TRACE_LINES} group by row_id)"""
#: Errors of the step profile with a method, their roots and call paths.
_MAPPED = f"""em as (
  select row_id, timestamp, service, method, service || '::' || method as qualified_name, {_STEP_CLASS} as error_type, message
  from ma where {_STEP} and method <> '<unknown>' and round(score, 4) > 0.01),
er as (select qualified_name as root, arg_min(error_type, row_id) as error_type, min(row_id) as first_row from em group by qualified_name),
roots as (select root from er)"""
_INSIDE = """cgi as (select root, split_part(callee, '::', 2) as call, count(*) as n_calls from cg where class = 'internal' group by all)"""
_AST = """ci as (
  select service || '::' || name as root, call, (length(call) % 3 + 1)::bigint as n_calls
  from (select service, name, rec_idx, unnest(callee_names) as call from m) where rec_idx % 3 = 0),
ins as (select * from ci union all select * from cgi where root not in (select root from ci))"""
_EVIDENCE = """ev as (
  select error_id, service, method, n_calls, n_logs, x[1][1] as first_ts, x[1][2] as first_row, x[2][1] as second_ts, x[2][2] as second_row
  from (
    select probe_id as error_id, p.service, call as method, n_calls, count(c.row_id) as n_logs,
      list((c.timestamp, c.row_id) order by c.timestamp, c.row_id) filter (where c.row_id is not null) as x
    from p join ins on root = p.service || '::' || p.method
      left join c on c.service = p.service and c.method = call and c.timestamp < p.at and c.timestamp >= p.at - 60.0
    group by all))"""


def _context(where: str) -> str:
    """Recommendations over the errors of the step profile that `where` keeps."""
    return _matched(
        S2,
        _MAPPED.replace("from ma where", f"from ma where row_id in (select row_id from s2 where {where}) and"),
        _E,
        *_G3,
        f"s9 as (select * from s2 where {where})",
        """pt as (
  select normalized_message, n, n::double / (select count(*) from s9) * 100 as percentage
  from (select signature, count(*) as n, arg_min(normalized, row_id) as normalized_message, min(row_id) as first_row from s9 group by signature) order by n desc, first_row limit 1)""",
        "rcs as (select root, first_row from er join cp using (root) where n_internal = 0 order by first_row limit 10)",
        "names9 as (select coalesce(list(root order by first_row), []) as methods from rcs)",
        "t as (select count(*) as total, count_if(error_type = 'timeout') as timeouts from s9)",
    ) + """select (row_number() over (order by o) - 1)::int as nth, priority, finding, pattern, methods, action from (
  select 1 as o, 'CRITICAL' as priority, 'One error pattern accounts for ' || round_even(percentage, 0)::bigint || '% of all errors' as finding,
    normalized_message as pattern, null::varchar[] as methods, 'Focus investigation on this specific error pattern' as action
  from pt, t where n > total * 0.5
  union all
  select 2, 'HIGH', 'Timeouts represent ' || round_even(timeouts::double / total * 100, 0)::bigint || '% of errors', null, null,
    'Check service response times, connection pools, and network latency' from t where timeouts > total * 0.3
  union all
  select 3, 'HIGH', 'Only ' || len(methods) || ' root cause methods identified', null, methods,
    'Investigate these methods - they have no incoming calls' from names9 where len(methods) <= 3)"""


_G3 = (REACH.format(depth=3), GRAPH.format(depth=3), PATHS)
_CONTEXT = (
    "t as (select count(*) as total_errors, count(distinct service) as services_affected, count_if(error_type = 'timeout') as timeouts, "
    "count(distinct signature) as unique_patterns, (select max(n) from (select count(*) as n from s2 group by signature)) as "
    "most_frequent, (select count(*) from c where is_error) as mapped_to_methods, (select count(*) from roots) as call_paths_traced "
    "from s2)"
)

ORACLE = {
    "clean_logs": _with(L) + f"select *, {_stamp('timestamp')} as timestamp_str from l",
    "detect_errors": _with(L, D) + f"select row_id, service, error_type, severity, {_stamp('timestamp')} as timestamp_str from d",
    "detect_errors_5class": _with(L) + f"select row_id, {_STEP_CLASS} as error_type from l where {_STEP}",
    "classify_4": _with(L) + f"select row_id, {_TRACE_CLASS} as error_type from l where {_ERROR}",
    "errors_filtered": _with(L, D) + (
        "select row_id, error_type, severity from d where service = 'cartservice' and timestamp >= 1704067300.0 and timestamp <= "
        "1704075000.0 and severity >= 7"
    ),
    "errors_of_type": _with(L, D) + "select row_id, error_type, message from d where error_type = 'TIMEOUT'",
    "exception_types": _with(L) + f"select row_id, {_EXCEPTION} as exception_type from l",
    "error_locations": _with(L) + f"select row_id, {_PLACE} as error_location from l",
    "trace_ids": _with(L) + f"select row_id, {_groups(E.TRACE_IDS, '(?i)')} as trace_id from l",
    "tracebacks_flag": _with(L) + f"select row_id, {_TRACEBACK} as has_traceback from l",
    **{f"normalize_{p}": _with(L) + f"select row_id, {N.duckdb_normalized('message', p)} as normalized from l" for p in N.RULES},
    "signatures_mine": _with(L, D, S) + "select row_id, signature from s",
    "signatures_steps": _with(L, S2) + "select row_id, error_type, signature from s2",
    "signatures_trace": _with(L, S3) + "select row_id, error_type, signature from s3",
    "patterns_signature": _patterns("signature", 5),
    "patterns_service_type": _patterns("service, error_type", 10),
    "patterns_steps": _with(L, S2, _samples("signature", 3, "s2")) + _step("s2", True),
    "patterns_trace": _with(L, S3, _samples("signature", 3, "s3")) + _step("s3", False),
    "error_summary": _with(L, D) + (
        "select count(*) as total_errors, count_if(has_traceback) as errors_with_traceback, list_sort(list_distinct(list(exception_type) "
        "filter (where exception_type is not null))) as unique_exceptions, min(timestamp) as start, max(timestamp) as \"end\", "
        "max(timestamp) - min(timestamp) as duration_seconds from d"
    ),
    "errors_by_type": _with(L, D) + _counts("error_type"),
    "errors_by_service": _with(L, D) + _counts("service"),
    "aggregation_stats": _with(L, D, S) + (
        "select count(*) as total_errors, count(distinct signature) as unique_patterns, count(distinct service) as services_affected, 1 - "
        "count(distinct signature)::double / count(*) as deduplication_ratio from s"
    ),
    "top_patterns": _with(L, D, S) + "select signature, count(*) as count, min(row_id) as first_row from s group by signature order by count desc, first_row limit 10",
    "first_traces": _with(L, D) + "select row_id, service, message from d where has_traceback order by row_id limit 3",
    "cpg_tokens": f"select page_id, {_tokens('html')} as tokens from pages",
    "string_literals": r"""select page_id, regexp_extract_all(html, '(?s)["`''](.*?)["`'']', 1) as literals from pages""",
    "word_tokens": r"select doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) as tokens from documents",
    "jaccard_pairs": _with(M) + """
select a.service, a.rec_idx as a, b.rec_idx as b, len(list_intersect(a.tokens, b.tokens))::double / len(list_distinct(list_concat(a.tokens, b.tokens))) as score
from m a join m b on a.service = b.service and a.rec_idx < b.rec_idx where list_has_any(a.tokens, b.tokens)""",
    "name_index": _with(M, NAMES) + "select * from names",
    "token_index": _with(M) + "select service, rec_idx, len(tokens) as n_tokens, unnest(tokens) as token from m",
    "method_index": _with(TREE) + (
        f"select root as node_id, any_value(n_name) as name, list_sort(list_distinct(flatten(list(list_concat({_tokens('n_name')}, "
        f"{_tokens(chr(39) + chr(39) + ' || coalesce(c_mktsegment, ' + chr(39) * 2 + ')')}, "
        f"{_tokens('coalesce(o_orderpriority, ' + chr(39) * 2 + ')')}))))) as tokens, "
        f"list_sort(list_distinct(flatten(list({_tokens('coalesce(o_orderpriority, ' + chr(39) * 2 + ')')})))) as call_tokens, "
        f"coalesce(list_sort(list_distinct(list(o_orderpriority) filter (where o_orderpriority is not null))), []) as callee_names from sub "
        f"join nation on root = 'n' || n_nationkey left join customer on node_id = 'c' || c_custkey left join orders on node_id = 'o' || "
        f"o_orderkey group by root"
    ),
    "match_logs": _matched() + "select row_id, service, method, rec_idx, full_name, score from ma",
    "match_logs_all_services": _with(
        L,
        M,
        f"lt as (select *, {_tokens('message')} as tokens from l)",
        "ix as (select service as svc, rec_idx, len(tokens) as n, unnest(tokens) as token from m)",
        (
            "pr as (select row_id, svc, rec_idx, n, len(tokens) as nt, count(*) as c from (select row_id, tokens, unnest(tokens) as token from "
            "lt) join ix using (token) group by all)"
        ),
        "pb as (select row_id, svc, max_by((rec_idx, c::double / (nt + n - c)), (c::double / (nt + n - c), -rec_idx)) as b from pr group by all)",
        (
            "pm as (select row_id, svc, m.rec_idx, name, full_name, line, round(b[2], 4) as score from pb join m on m.service = svc and "
            "m.rec_idx = b[1] where round(b[2], 4) >= 0.01)"
        ),
        """pk as (
  select row_id, count(*) as n_candidates, list(svc || '::' || name order by score desc, svc) as candidates, list(svc order by score desc, svc)[1] as best_service,
    list(rec_idx order by score desc, svc)[1] as best_rec_idx, list(name order by score desc, svc)[1] as best_method, list(full_name order by score desc, svc)[1] as best_full_name,
    list(line order by score desc, svc)[1] as best_line, max(score) as best_score from pm group by row_id)""",
    )
    + """
select row_id, coalesce(n_candidates, 0) as n_candidates, coalesce(candidates, []) as candidates, best_service, best_rec_idx, coalesce(best_method, '<unknown>') as best_method,
  coalesce(best_full_name, '') as best_full_name, coalesce(best_line, '') as best_line, coalesce(best_score, 0.0)::double as best_score
from l left join pk using (row_id)""",
    "method_calls": _matched(CALLS) + "select * from c",
    "activity": _matched() + f"select service, method, {_stamp('timestamp')} as bucket, count(*) as count from ma group by all",
    "edges_intra": _with(M, NAMES, INTRA) + "select * from ei",
    "edges_inter": _with(M, NAMES, INTER) + "select * from ex",
    "edges_all": _with(EDGES) + "select * from e",
    "ast_subtree": _with(TREE) + "select * from sub",
    "call_graph": _with(EDGES, ROOTS, REACH.format(depth=3), GRAPH.format(depth=3)) + "select * from cg",
    "reachable_depth": _with(EDGES, ROOTS, REACH.format(depth=10)) + "select * from rc",
    "call_paths": _matched(CALLS, _E, EROOTS, *_G3) + "select * from cp",
    "root_causes": _matched(CALLS, _E, EROOTS, *_G3) + "select root from cp where n_internal = 0",
    "complex_paths": _matched(_MAPPED, _E, *_G3) + (
        "select root as method, error_type, total_reachable, call_depth, services_involved, first_row from er join cp using (root) order by "
        "total_reachable desc, first_row limit 10"
    ),
    "root_causes_first": _matched(_MAPPED, _E, *_G3)
    + """select root as method, error_type, 'No incoming calls (potential root cause)' as reason, n_outbound as outbound_calls, services_involved, first_row
from er join cp using (root) where n_internal = 0 order by first_row limit 10""",
    "path_totals": _matched(_MAPPED, _E, *_G3) + (
        "select count(*) as call_paths, coalesce(sum(n_internal), 0)::bigint as internal_calls, coalesce(sum(n_outbound), 0)::bigint as "
        "outbound_calls from cp"
    ),
    "errors_mapped_by_service": _matched(_MAPPED) + _counts("service", "em"),
    "errors_mapped_by_type": _matched(_MAPPED) + _counts("error_type", "em"),
    "top_step_patterns": _with(L, S2, _samples("signature", 3, "s2"))
    + f"""
select signature, error_type, count, count::double / (select count(*) from s2) * 100 as percentage, services, normalized_message,
  {_iso('first_seen')} as first_seen, {_iso('last_seen')} as last_seen, sample_messages, first_row
from (
  select signature, count(*) as count, list_sort(list_distinct(list(service))) as services, min(timestamp) as first_seen, max(timestamp) as last_seen,
    arg_min(error_type, row_id) as error_type, arg_min(normalized, row_id) as normalized_message, min(row_id) as first_row from s2 group by signature) join sm using (signature)
order by count desc, first_row limit 10""",
    "calls_below": """
select 'n' || n_nationkey as node_id, o_orderpriority as call, count(*) as n_calls from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by all
union all
select 'r' || n_regionkey, o_orderpriority, count(*) from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by all""",
    "potential_external": _with(EDGES, ROOTS, REACH.format(depth=3)) + (
        "select distinct root, method, callee from rc join (select service || '::' || name as q, unnest(callee_names) as callee from m) on "
        "q = method where callee not in (select key from names)"
    ),
    "callers": _with(EDGES) + f"select callee as method, caller, {_home('caller')} <> {_home('callee')} as is_external from e where kind = 'CALL'",
    "error_window": _matched(CALLS, _window(10.0)) + "select row_id, qualified_name, start_ts, end_ts from w",
    "window_summary": _matched(CALLS, _window(600.0)) + (
        "select count(*) as total_calls, count_if(is_error) as error_count, list_sort(list_distinct(list(service))) as services, "
        "min(timestamp) as start, max(timestamp) as \"end\", arg_min(row_id, (timestamp, row_id)) filter (where is_error) as "
        "first_error_row from w"
    ),
    "flows_time": _matched(CALLS, _sessions(2.0)) + "select row_id, session from ses",
    "flow_stats": _matched(CALLS, _sessions(2.0)) + (
        "select count(*) as n_calls, list_sort(list_distinct(list(service))) as services_involved, min(timestamp) as start_time, "
        "max(timestamp) as end_time, max(timestamp) - min(timestamp) as duration, bool_or(is_error) as has_error, count_if(is_error) as "
        "error_count, 'flow_' || case when session < 10000 then lpad(session::bigint::varchar, 4, '0') else session::bigint::varchar end as "
        "flow_id from ses group by session"
    ),
    "flow_connections": _matched(CALLS, _E, _sessions(6.0), "pr as (select caller, callee from e where kind = 'CALL' union select callee, caller from e where kind = 'CALL')") + (
        f"select a.session as flow, a.row_id as from_row, b.row_id as to_row, {_home('a.qualified_name')} <> {_home('b.qualified_name')} as "
        f"cross_service from ses a join ses b on a.session = b.session and (a.timestamp, a.row_id) < (b.timestamp, b.row_id) join pr on "
        f"pr.caller = a.qualified_name and pr.callee = b.qualified_name"
    ),
    "timeline_arrows": _matched(CALLS, _E, _window(3600.0), "o as (select *, row_number() over (order by row_id) as nth from w)") + (
        f"select a.row_id as from_row, b.row_id as to_row, {_home('a.qualified_name')} <> {_home('b.qualified_name')} as cross_service from "
        f"o a join o b on b.nth > a.nth and b.nth <= a.nth + 19 and abs(b.timestamp - a.timestamp) <= 2.0 where (a.qualified_name, "
        f"b.qualified_name) in (select (caller, callee) from e where kind = 'CALL')"
    ),
    "method_labels": _matched(CALLS)
    + "select *, case service "
    + " ".join(f"when '{k}' then '{v}'" for k, v in X.SERVICE_LABELS.items())
    + f""" else substr(service, 1, 4) end || '-' || row_number() over (partition by service order by first_row) as label, {_clock('first_timestamp')} as first_time_str
from (
  select service, method, qualified_name, min(row_id) as first_row, arg_min(timestamp, row_id) as first_timestamp, count(*) as total_calls, arg_min(is_error, row_id) as is_error,
    arg_min(message, row_id) as message, arg_min(score, row_id) as score from c group by service, method, qualified_name)""",
    "lanes": _matched(CALLS) + (
        "select service, lane, ((select count(distinct service) from c) - 1 - lane) * 2.5::double as y from (select service, row_number() "
        "over (order by min((timestamp, row_id))) - 1 as lane from c group by service)"
    ),
    "stacking": _matched(CALLS) + (
        "select row_id, bucket, row_number() over (partition by service, bucket order by row_id) - 1 as nth, count(*) over (partition by "
        "service, bucket) as in_bucket from (select *, trunc((timestamp - (select min(timestamp) from c)) / 15.0::double)::int as bucket "
        "from c)"
    ),
    "short_labels": _with(M) + "select service, name, case service " + " ".join(f"when '{k}' then '{v}'" for k, v in X.SERVICE_LABELS.items()) + (
        " else substr(service, 1, 4) end as service_label, upper(case when length(name) > 8 then substr(name, 1, 3) else substr(name, 1, 4) "
        "end) as method_label from m"
    ),
    "evidence_before_10": _evidence(10.0),
    "evidence_before_60": _evidence(60.0),
    "method_logs_before": _matched(CALLS, _PROBES) + (
        "select probe_id, c.row_id from p join c on c.service = p.service and c.method = p.method and c.timestamp < p.at and c.timestamp >= "
        "p.at - 60.0"
    ),
    "call_evidence": _matched(CALLS, _PROBES, _E, ROOTS, REACH.format(depth=2), GRAPH.format(depth=2), _INSIDE, "ins as (select * from cgi)", _EVIDENCE) + "select * from ev",
    "call_evidence_inside": _matched(CALLS, _PROBES, _E, ROOTS, REACH.format(depth=2), GRAPH.format(depth=2), _INSIDE, _AST, _EVIDENCE) + "select * from ev",
    "intra_analysis": _matched(CALLS, _PROBES, _E, ROOTS, REACH.format(depth=2), GRAPH.format(depth=2), _INSIDE, _AST, _EVIDENCE, "evx as (select ev.*, unnest(range(n_calls)) as copy from ev)")
    + """
select *, coalesce(matched_calls::double / nullif(total_calls, 0), 0.0)::double as confidence from (
  select probe_id as error_id, p.service || '::' || p.method as error_method, p.service, coalesce(list(evx.method order by evx.method) filter (where evx.method is not null), []) as all_internal_calls,
    coalesce(list(evx.method order by first_ts, evx.method) filter (where n_logs > 0), []) as executed_calls, coalesce(list(evx.method order by evx.method) filter (where n_logs = 0), []) as not_executed_calls,
    count(evx.method) as total_calls, count(evx.method) filter (where n_logs > 0) as matched_calls
  from p left join evx on evx.error_id = p.probe_id group by probe_id, p.service, p.method)""",
    "backward_trace": _matched(
        CALLS,
        L2,
        _PROBES,
        NAMES,
        """oc as (
  select a.service || '::' || a.name as caller, b.service || '::' || b.name as callee, min(a.rec_idx::bigint * 2147483648 + pos) as ord
  from (select service, name, rec_idx, unnest(callee_names) as key, generate_subscripts(callee_names, 1) - 1 as pos from m) a
    join names using (service, key) join m b on b.service = a.service and b.rec_idx = names.rec_idx group by all)""",
        """men as (
  select q, timestamp from l2 join (select distinct caller as q, split_part(caller, '::', 1) as service, split_part(caller, '::', 2) as method from oc) o
    on o.service = l2.service and contains(message, method))""",
        """tr(error_id, head, t0, path, times, confidences, d) as (
  select probe_id, service || '::' || method, p.at, [service || '::' || method], [p.at], []::double[], 0 from p
  union all
  select error_id, caller, ts, list_prepend(caller, path), list_prepend(ts, times), list_prepend(round(1 - (t0 - ts) / 60.0::double, 4), confidences), d + 1 from (
    select t.*, oc.caller, men.timestamp as ts, row_number() over (partition by error_id order by men.timestamp desc, oc.ord) as nth
    from tr t join oc on oc.callee = t.head and not list_contains(t.path, oc.caller) join men on men.q = oc.caller and men.timestamp < t.t0 and t.t0 - men.timestamp < 60.0
    where t.d < 10) where nth = 1)""",
        "ends as (select error_id, arg_max(path, d) as path, arg_max(times, d) as times, arg_max(confidences, d) as confidences from tr group by error_id)",
    )
    + """
select error_id, path as execution_path, [path[1]] as root_methods, list_sort(list_distinct(list_transform(path, lambda x: split_part(x, '::', 1)))) as services_involved,
  times[1] as start_time, times[-1] as end_time, times[-1] - times[1] as duration, confidences from ends""",
    "error_ids": _matched(CALLS, _PROBES)
    + (
        "select probe_id as error_id, 'error_' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end as error_name from "
        "(select probe_id, row_number() over (order by probe_id) - 1 as n from p)"
    ),
    "trace_summary": _matched(CALLS, _PROBES, S3) + (
        "select count(*) as total_errors, count(*) as analyzed, count(distinct service) as services_analyzed, (select count(distinct "
        "signature) from s3) as unique_patterns from p"
    ),
    "llm_window_summary": _matched(CALLS, _window(600.0))
    + f"""select count(*) as total_method_calls, count_if(is_error) as error_count, list_sort(list_distinct(list(service))) as services, max(end_ts - start_ts) as time_range_seconds,
  {_iso('(min(timestamp) filter (where is_error))')} as first_error_time from w""",
    "llm_window_errors": _matched(CALLS, _window(600.0)) + f"select service, method, message, {_iso('timestamp')} as timestamp, row_id as nth from w where is_error",
    "llm_method_sequence": _matched(CALLS, _window(600.0)) + f"select service, method, is_error, {_iso('timestamp')} as timestamp, row_id as nth from w",
    "llm_call_relationships": _with(EDGES) + "select caller, callee from e where kind = 'CALL'",
    "llm_flows": _matched(CALLS, _E, _window(600.0), _flows(2.0, "w"))
    + f"""select flow_id, root_methods, leaf_methods, services_involved, round(duration, 3) as duration_seconds, has_error, error_count, method_sequence from ft
join (select flow, list(qualified_name || '|' || {_iso('timestamp')} || '|' || is_error::varchar order by timestamp, row_id) as method_sequence from fc group by flow) using (flow)""",
    "flows": _matched(CALLS, _E, _flows(2.0)) + "select * exclude (flow) from ft",
    "traceback_lines": _with(L, _LINES) + "select row_id, traceback_lines from lines",
    "patterns_traces": _with(L, D, S, _LINES) + "select signature, row_id, nth::int as nth, line from tk join s using (row_id) where nth < 3",
    "call_times": _matched(CALLS) + f"select qualified_name, row_id, {_clock('timestamp')} as time_str from c",
    "axis_ticks": _matched(CALLS)
    + """select round(case when n > 1 then r * i / (n - 1) else 0.0 end, 6) as tick
from (select r, n, unnest(range(n)) as i from (select max(timestamp) - min(timestamp) as r, least(30, floor(max(timestamp) - min(timestamp))::int + 1) as n from c))""",
    "log_statistics": _with(L) + (
        "select count(*) as rows, count(distinct service) as services, count_if(message = '') as empty_messages, min(timestamp) as first, "
        "max(timestamp) as last from l"
    ),
    "rca_nodes": _matched(CALLS) + (
        "select qualified_name, service, method, count(*) as call_count, count_if(is_error) as error_count, arg_min(timestamp, row_id) as "
        "first_seen, max(timestamp) as last_seen from c group by all"
    ),
    "rca_edges": _matched(CALLS, _E) + (
        f"select caller, callee, count(*) as count, {_home('caller')} <> {_home('callee')} as cross_service from e where kind = 'CALL' and "
        f"caller in (select qualified_name from c) and callee in (select qualified_name from c) group by caller, callee"
    ),
    "service_stats": _matched(CALLS) + (
        "select service, count(*) as calls, count_if(is_error) as errors, count_if(is_error)::double / count(*) as error_rate from c group "
        "by service"
    ),
    "rca_error_summary": _matched(CALLS) + (
        "select count(distinct qualified_name) as total_errors, count(distinct qualified_name) as methods_with_errors, "
        "list_sort(list_distinct(list(service))) as affected_services from c where is_error"
    ),
    "service_ranking": _matched(CALLS) + (
        "select service, sum(e) as errors, sum(n) as calls, min(f) filter (where e > 0) as first_error, sum(e)::double / sum(n) as score "
        "from (select service, qualified_name, count(*) as n, count_if(is_error) as e, arg_min(timestamp, row_id) as f from c group by all) "
        "group by service"
    ),
    "top_methods": _matched(CALLS) + "select qualified_name, count(*) as count from c where is_error group by qualified_name order by count desc, min(row_id) limit 10",
    "mapping_coverage": _matched() + (
        f"select service, count(*) as errors, count_if(method <> '<unknown>' and round(score, 4) > 0.01) as mapped, count_if(method <> "
        f"'<unknown>' and round(score, 4) > 0.01)::double / count(*) as coverage from ma where {_STEP} group by service"
    ),
    "context_summary": _matched(CALLS, EROOTS, S2, _CONTEXT) + (
        "select *, 1 - unique_patterns::double / total_errors as deduplication_ratio, mapped_to_methods::double / total_errors as "
        "mapping_rate from t"
    ),
    "recommendations": _context("true"),
    "recommendations_timeouts": _context("error_type = 'timeout' and service in ('redis', 'adservice')"),
    "session_window_batch": _with(L) + (
        "select service, min(us) as start_us, count(*) as n from (select *, sum(new) over (partition by service order by us, row_id) as k "
        "from (select *, case when us - lag(us) over (partition by service order by us, row_id) <= 2000000 then 0 else 1 end as new from "
        "(select *, "
    ) + X.duckdb_micros("timestamp") + " as us from l))) group by service, k",
    "times_text": _with(L) + f"select row_id, substr(strftime(make_timestamp({X.duckdb_micros('timestamp')}), '%H:%M:%S.%f'), 1, 12) as clock from l",
    "times_iso": _with(L) + (
        f"select row_id, case when us % 1000000 = 0 then strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') else strftime(make_timestamp(us), "
        f"'%Y-%m-%dT%H:%M:%S.%f') end as iso from (select row_id, {X.duckdb_micros('timestamp')} as us from l)"
    ),
    "errors_with_traceback": _with(L, D) + "select row_id, service, error_type from d where has_traceback",
    "errors_first": _with(L, D) + "select row_id as first_row, service, error_type from d order by row_id limit 50",
    "logs_first_of_services": _with(L) + "select row_id, service from (select *, row_number() over (partition by service order by row_id) as nth from l) where nth <= 20",
    "messages_shortened": _with(L) + "select row_id, substr(message, 1, 30) as message, round_even(timestamp - (select min(timestamp) from l), 3) as seconds from l",
    "call_names": "select event_id, case when event_id % 3 > 0 then event_type end as call from events",
    "short_labels_of_parts": """
select event_id, name, upper(case when length(name) > 8 and len(parts) > 1 then substr(parts[1], 1, 1) || substr(parts[2], 1, 1) when length(name) > 8 then substr(name, 1, 3) else substr(name, 1, 4) end) as label
from (
  select event_id, name, list_filter(string_split(name, '_'), lambda x: x <> '') as parts
  from (select event_id, event_type || case when event_id % 2 = 0 then '_of_user' else '' end || '__' || (user_id % 5) as name from events))""",
    "activity_by_second": _with(L) + f"select service, {_stamp('timestamp')} as second, count(*) as count from l group by all",
}
