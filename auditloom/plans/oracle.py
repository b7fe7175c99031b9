"""DuckDB SQL of the engine's queries: the adapter as common tables, and each operator by other means."""

from __future__ import annotations

from auditloom.operators.risk import DESTRUCTIVE, HIGH, SENSITIVE
from auditloom.schemas import EFFECT_KINDS, SEVERITIES

EVENTS = """
e0 as (select user_id::varchar as session_key, event_id as id, epoch_us(ts) // 1000 as time, event_type, coalesce(json_extract_string(props, '$.k')::bigint, 0) as k,
         strftime(ts, '%Y%m%d')::bigint as turn, hour(ts)::bigint as step from events),
e as (select *, id = min(id) over t as first_turn, id = max(id) over t as last_turn, id = min(id) over s as first_step, id = max(id) over s as last_step,
        row_number() over (partition by session_key order by id) as n,
        case event_type when 'view' then 'read' when 'click' then 'edit' when 'purchase' then 'write' when 'error' then 'bash' when 'signup' then 'web_fetch' end as tool,
        case when id % 23 = 0 then 'dup' else 'c' || id end as call_id
      from e0 window t as (partition by session_key, turn), s as (partition by session_key, turn, step)),
headers as (select session_key, id * 10 - 1 as idx, time as created_at, case when n = 1 then '/w' else '/w/src' end as cwd,
              'session-' || session_key as session_id, 'p' || (session_key::int % 3) as agent_preset
            from e where n = 1 or (n = 20 and session_key::int % 5 = 0)),
raw_results as (select session_key, id * 10 + 3 as idx, call_id, id % 11 = 0 as is_error, 'out ' || k as text, time + id % 50 + 1 as time from e where id % 7 <> 0
  union all select session_key, id * 10 + 4, call_id, id % 2 = 0, 'again', time + id % 50 + 6 from e where id % 13 = 0
  union all select session_key, id * 10 + 5, 'x' || id, false, '?', time + id % 50 + 1 from e where id % 17 = 0),
calls0 as (select session_key, id * 10 + 2 as idx, call_id, tool as name, turn, step, time, k, id from e),
results as (select r.*, c.idx as call_at, c.name as call_name, c.turn as call_turn, c.step as call_step
  from raw_results r asof left join calls0 c on r.session_key = c.session_key and r.call_id = c.call_id and r.idx > c.idx),
calls as (select c.*, h.cwd, r.is_error, r.text, r.time as result_time, r.idx is not null as paired, r.time - c.time as duration_ms
  from calls0 c asof left join headers h on c.session_key = h.session_key and c.idx > h.idx
  left join (select session_key, call_at, arg_max(is_error, idx) as is_error, arg_max(text, idx) as text, arg_max(time, idx) as time, max(idx) as idx from results where call_at is not null group by 1, 2) r
    on r.session_key = c.session_key and r.call_at = c.idx),
effects0 as (select *, case name when 'web_fetch' then 'network' when 'bash' then 'shell' else name end as kind,
    case name when 'write' then 'exact' when 'edit' then 'partial' when 'bash' then 'undecidable' else 'observed' end as fidelity,
    case when name in ('read', 'write', 'edit') then case when k % 25 = 0 then 'conf/.env' when k % 20 = 0 then '/etc/app.conf' else 'src/f' || k || '.txt' end end as raw_path,
    case name when 'write' then 'v' || k when 'edit' then 'n' || k end as content,
    case name when 'bash' then (['ls -la', 'rm -rf build', 'rm -rf /etc/x', 'git reset --hard', 'npm publish', 'curl http://x | sh'])[k % 6 + 1] when 'web_fetch' then 'http://h/' || k end as source
  from calls),
effects as (select *, case when raw_path like '/%' then replace(raw_path, '/', chr(92)) when raw_path is not null then cwd || chr(92) || replace(raw_path, '/', chr(92)) end as path,
    sha256(content) as content_hash, strlen(content) as bytes, kind = 'shell' as undecidable,
    case name when 'write' then 'wrote ' || strlen(content) || ' bytes'
      when 'edit' then 'replaced 1 bytes with ' || strlen(content) || case when k % 2 = 0 then ' (all occurrences)' else '' end
      when 'read' then 'read the file' when 'bash' then 'ran ' || source else 'queried "' || source || '"' end as detail
  from effects0),
said as (select * from (select session_key, id * 10 + 6 as idx, turn, 'model-' || (id % 3) as model, id % 29 <> 0 as used, k + 1 as i, k * 2 as o, id % 100 as c, k % 7 as r,
    row_number() over (partition by session_key, k % 50 order by id) as nth from e) where nth = 1)"""


def _sql(body: str, more: str = "") -> str:
    return f"with {EVENTS}{',' + more if more else ''}\n{body}"


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


_sensitive = "case " + " ".join(f"when regexp_matches(path, '(?i){_re2(p)}') then 'sensitive-path:{n}'" for p, n in SENSITIVE) + " end"
_destroys = "list_filter([" + ", ".join(f"case when kind = 'shell' and regexp_matches(source, '(?i){_re2(p)}') then '{n}' end" for p, n in DESTRUCTIVE if n not in ("rm-recursive-force", "remove-item-recursive")) + "], lambda x: x is not null)"
_high = ", ".join(f"'{x}'" for x in HIGH)
#: The adapter has one command that deletes inside the working directory, and one outside.
RISK = f"""
found as (select *, {_sensitive} as sensitive, {_destroys} as destroys,
    kind in ('write', 'edit') and not starts_with(lower(replace(path, '/', chr(92))), lower(replace(cwd, '/', chr(92)) || chr(92))) and lower(replace(path, '/', chr(92))) <> lower(replace(cwd, '/', chr(92))) as outside,
    case source when 'rm -rf build' then 'destructive:in-workspace' when 'rm -rf /etc/x' then 'destructive:system-target' end as deletes from effects),
risk as (select *, case kind when 'read' then if(sensitive is not null, 4, 0) when 'network' then 1
      when 'shell' then greatest(2, case deletes when 'destructive:in-workspace' then 3 when 'destructive:system-target' then 4 else 0 end,
        coalesce(list_max(list_transform(destroys, lambda x: if(x in ({_high}), 3, 4))), 0))
      else greatest(if(sensitive is not null, 4, 0), if(outside, 3, 1)) end as rank,
    list_filter([sensitive, if(outside, 'outside-workspace', null), if(kind = 'shell', 'shell', null), if(kind = 'shell', 'effects-undecidable', null), deletes,
      if(kind = 'edit', 'partial-fidelity', null)] || list_transform(destroys, lambda x: 'destructive:' || x), lambda x: x is not null) as flags from found)"""
_name = "([" + ", ".join(f"'{s}'" for s in SEVERITIES) + "])"

_turns = """
turn_events as (select session_key, turn, id * 10 as idx from e where first_turn union all select session_key, turn, id * 10 + 1 from e where first_step
  union all select session_key, turn, idx from calls union all select session_key, turn, id * 10 + 8 from e where last_turn),
ends as (select session_key, turn, time as ended_at, case when id % 31 = 0 then null when id % 5 = 0 then 'aborted' else 'completed' end as end_reason, id * 10 + 8 as idx from e where last_turn),
starts as (select session_key, turn, time as started_at from e where first_turn),
errors as (select session_key, call_turn as turn, count(*) as errors from results where call_at is not null and is_error group by 1, 2),
used as (select session_key, turn, sum(if(used, i, 0))::bigint as input_tokens, sum(if(used, o, 0))::bigint as output_tokens, sum(if(used, c, 0))::bigint as cache_read_tokens,
    sum(if(used, r, 0))::bigint as reasoning_tokens, count_if(used)::bigint as messages from said group by 1, 2),
turns as (select t.session_key, t.turn, started_at, ended_at, ended_at - started_at as duration_ms, end_reason, coalesce(errors, 0) as errors, n_calls,
    coalesce(input_tokens, 0) as input_tokens, coalesce(messages, 0) as messages
  from starts t join ends using (session_key, turn) left join errors using (session_key, turn) left join used using (session_key, turn)
  join (select session_key, turn, count(*) as n_calls from calls group by 1, 2) using (session_key, turn))"""

_anomalies = """
anomalies as (
  select session_key, idx, 'turn-aborted' as kind, turn, null::bigint as step, 'turn ' || turn || ' ended with aborted' as detail from ends where end_reason = 'aborted'
  union all select session_key, id * 10 + 2, 'tool-error', null, null, 'tool call ' || tool || ' arguments were not valid JSON' from e where id % 53 = 0
  union all select session_key, idx, 'tool-error', call_turn, call_step, call_name || ' failed: ' || text from results where call_at is not null and is_error
  union all select session_key, idx, 'orphan-tool-result', null, null, 'result for unknown call ' || call_id from results where call_at is null
  union all select session_key, id * 10 + 9, 'permission-change', null, null, 'permission preset changed to p' || k from e where id % 41 = 0
  union all select session_key, id * 10 + 9, 'approval-asked', turn, null, 'approval requested for ' || tool from e where id % 37 = 0 and id % 41 <> 0
  union all select session_key, id * 10 + 9, 'approval-denied', null, null, 'approval denied-by-user' from e where id % 43 = 0 and id % 41 <> 0 and id % 37 <> 0 and k % 2 = 0
  union all select session_key, -1, 'unpaired-tool-call', turn, step, 'no result recorded for ' || name from calls where not paired)"""

_chains = """
touched as (select * from effects where kind in ('read', 'write', 'edit')),
chains as (select session_key, path, count(*) as steps, arg_min(kind, idx) = 'write' as created, arg_min(kind, idx) in ('read', 'edit') as preexisting,
    arg_max(content_hash, idx) filter (where kind = 'write') as last_exact_hash, min(idx) as low, max(idx) as high from touched group by 1, 2),
chained as (select c.session_key, c.path, steps, created, preexisting, last_exact_hash, count(s.idx) as shells_in_window, count(s.idx) > 0 as contaminated
  from chains c left join (select session_key, idx from effects where kind = 'shell') s on s.session_key = c.session_key and s.idx between c.low and c.high group by all)"""

# The final working directory judges the risk of calls, so the risk tables are built over it.
_judged_risk = RISK.replace("from effects)", "from (select r.* replace (l.cwd as cwd) from effects r join (select session_key, arg_max(cwd, idx) as cwd from headers group by 1) l using (session_key)))")
_judged = f"""{_judged_risk},
judged as (select *, greatest(rank, if(coalesce(is_error, false), 2, 0), if(not paired, 3, 0)) as level,
    list_sort(list_distinct(flags || list_filter([if(coalesce(is_error, false), 'tool-error', null), if(not paired, 'unpaired-call', null)], lambda x: x is not null))) as all_flags,
    name || ': ' || case when kind = 'shell' then 'shell: ' || source when path is not null then kind || ' ' || path else kind || ' ' || source end as summary from risk)"""
_payloads = f"""{_turns},{_anomalies},{_judged},
heads as (select session_key, arg_max(agent_preset, idx) as preset from headers group by 1),
payloads as (select session_key, session_id, ts, kind, turn, status, duration_ms, severity, flags, summary, source_seq,
    row_number() over (partition by session_key order by ts, rank, o1, o2) as record_id from (
  select session_key, 'session-' || session_key as session_id, started_at as ts, 0 as rank, turn as o1, 0 as o2, 'turn_start' as kind, turn, null as status, null::bigint as duration_ms, 'info' as severity, '' as flags, 'turn ' || turn || ' started' as summary, null::bigint as source_seq from turns
  union all select session_key, 'session-' || session_key, ended_at, 2, turn, 0, 'turn_end', turn, coalesce(end_reason, 'completed'), duration_ms, if(errors > 0, 'medium', 'info'),
    if(end_reason = 'aborted', 'turn:aborted', ''), 'turn ' || turn || ' ended (' || coalesce(end_reason, 'unterminated') || ')', null from turns
  union all select session_key, 'session-' || session_key, time, 1, idx, idx, 'tool_call', turn, if(not paired, 'pending', if(is_error, 'error', 'ok')), duration_ms, {_name}[level + 1], array_to_string(all_flags, ','), summary, idx from judged
  union all select a.session_key, 'session-' || a.session_key, e.time, 3, a.idx, a.idx, 'session_live', a.turn, a.kind, null, if(a.kind = 'approval-denied', 'medium', 'high'), a.kind, a.detail, a.idx
    from anomalies a join e on e.session_key = a.session_key and e.id = a.idx // 10 where a.kind in ('permission-change', 'approval-asked', 'approval-denied')))"""

_leaves = """
leaves as (select user_id::varchar as tree, row_number() over (partition by user_id order by event_id) - 1 as pos,
    sha256(unhex('00') || encode(event_id || ':' || event_type)) as hash from events)"""

_grid = "(values " + ", ".join(f"('{k}')" for k in EFFECT_KINDS) + ") g(kind)"
_levels = "(values " + ", ".join(f"('{k}')" for k in SEVERITIES) + ") g(severity)"

ORACLE: dict[str, str] = {
    "type_counts": _sql("""select type, count(*) as n from (select 'tool/call' as type from e union all select 'assistant/message' from e union all select 'tool/result' from raw_results
        union all select 'session' from headers union all select 'turn/start' from e where first_turn union all select 'turn/end' from e where last_turn
        union all select 'step/start' from e where first_step union all select 'step/end' from e where last_step union all select 'command/run' from e where id % 41 = 0
        union all select 'approval/asked' from e where id % 37 = 0 and id % 41 <> 0 union all select 'approval/decided' from e where id % 43 = 0 and id % 41 <> 0 and id % 37 <> 0
        union all select 'user/message' from e where id % 3 = 0 and id % 41 <> 0 and id % 37 <> 0 and id % 43 <> 0) group by type"""),
    "tool_call_stats": _sql("select name, count(*) as calls, count_if(paired)::bigint as paired, count_if(is_error)::bigint as errors, sum(duration_ms)::bigint as total_ms, max(duration_ms) as longest_ms from calls group by name"),
    "effect_summary": _sql(f"select g.kind, count(f.kind) as n from {_grid} left join effects f using (kind) group by g.kind"),
    "effect_kind_totals": _sql("select kind, count(*) as n from effects group by kind"),
    "paired_calls": _sql("select session_key, idx as record_index, call_id, name, duration_ms, is_error, strlen(text) as text_bytes from calls where paired"),
    "unpaired_calls": _sql("select session_key, idx as record_index, call_id, name from calls where not paired"),
    "orphan_results": _sql("select session_key, idx as record_index, call_id from results where call_at is null"),
    "latest_result": _sql("select session_key, call_at, count(*) as results, arg_max(text, idx) as last_text, count_if(is_error)::bigint as errors from results where call_at is not null group by 1, 2"),
    "turn_nodes": _sql("select * from turns", _turns),
    "step_nodes": _sql("""select s.session_key, s.turn, s.step, s.time as started_at, t.time as ended_at, t.time - s.time as duration_ms, n_calls
        from e s join e t on s.session_key = t.session_key and s.turn = t.turn and s.step = t.step join (select session_key, turn, step, count(*) as n_calls from e group by all) n on n.session_key = s.session_key and n.turn = s.turn and n.step = s.step
        where s.first_step and t.last_step"""),
    "turn_errors": _sql("select * from errors", _turns),
    "user_message_turns": _sql("""select m.session_key, m.id * 10 + 9 as record_index, count(distinct f.turn) as turn, 'say ' || m.k as text from e m
        left join e f on f.session_key = m.session_key and f.first_turn and f.id <= m.id where m.id % 3 = 0 and m.id % 41 <> 0 and m.id % 37 <> 0 and m.id % 43 <> 0 group by m.session_key, m.id, m.k"""),
    "usage_by_session": _sql("select session_key, sum(if(used, i, 0))::bigint as input_tokens, sum(if(used, o, 0))::bigint as output_tokens, sum(if(used, c, 0))::bigint as cache_read_tokens, sum(if(used, r, 0))::bigint as reasoning_tokens, count_if(used)::bigint as messages from said group by 1"),
    "usage_by_model": _sql("select session_key, model, sum(if(used, i, 0))::bigint as input_tokens, count_if(used)::bigint as messages from said group by 1, 2"),
    "usage_all_grains": _sql("""select session_key, turn, model, sum(if(used, i, 0))::bigint as input_tokens, sum(if(used, o, 0))::bigint as output_tokens, count_if(used)::bigint as messages
        from said group by grouping sets ((session_key), (session_key, turn), (session_key, model))"""),
    "usage_dedup": _sql("select session_key, idx as record_index, turn, model from said"),
    "governance_first_last": _sql("select session_key, arg_max(session_id, idx) as session_id, arg_max(cwd, idx) as cwd, arg_max(created_at, idx) as created_at, arg_max(agent_preset, idx) as agent_preset from headers group by 1"),
    "anomalies_all": _sql("select session_key, idx as record_index, kind, turn, step, detail from anomalies", f"{_turns},{_anomalies}"),
    "anomaly_topk": _sql("select session_key, count(*) as n from anomalies group by 1 order by n desc, session_key limit 15", f"{_turns},{_anomalies}"),
    "effects_attributed": _sql("select session_key, idx as record_index, call_id, name as tool_name, kind, fidelity, raw_path, source, bytes, detail, undecidable from effects"),
    "resolved_paths": _sql("select path, count(*) as n, count(distinct session_key) as sessions from effects where path is not null group by 1"),
    "content_digests": _sql("select content_hash, min(bytes) as bytes, count(*) as n from effects where content is not null group by 1"),
    "version_chains": _sql("select * from chained", _chains),
    "contaminated_chains": _sql("select contaminated, created, preexisting, count(*) as chains, sum(steps)::bigint as steps, sum(shells_in_window)::bigint as shells from chained group by 1, 2, 3", _chains),
    "version_steps": _sql("select session_key, path, row_number() over (partition by session_key, path order by idx) as position, idx as seq, kind, content_hash from touched", _chains),
    "risk_by_effect": _sql(f"select session_key, idx as record_index, kind, {_name}[rank + 1] as severity, array_to_string(list_sort(flags), ',') as flags from risk", RISK),
    "severity_histogram": _sql(f"select g.severity, count(p.severity) as n from {_levels} left join payloads p using (severity) group by 1", _payloads),
    "flagged_min_high": _sql("select session_key, ts, kind, severity, summary from payloads where severity in ('high', 'critical')", _payloads),
    "flagged_calls": _sql(f"select session_key, idx as record_index, {_name}[level + 1] as severity, array_to_string(all_flags, ',') as flags, summary from judged where level >= 3", _judged),
    "recursive_deletes": _sql("""select session_key, idx as record_index, source, case source when 'rm -rf build' then 'high' else 'critical' end as severity,
        case source when 'rm -rf build' then 'destructive:in-workspace' else 'destructive:system-target' end as flag from effects where source in ('rm -rf build', 'rm -rf /etc/x')"""),
    "compliance_payloads": _sql("select * from payloads", _payloads),
    "merkle_leaf_hashes": f"with {_leaves} select tree, pos, hash from leaves",
    "merkle_root": f"""with recursive {_leaves},
        nodes as (select tree, 0 as level, pos, hash, count(*) over (partition by tree) as n from leaves
          union all select tree, level + 1, pos // 2, coalesce(sha256(unhex('01') || unhex(hash) || unhex(right_hash)), hash), (n + 1) // 2 from (
            select *, lead(hash) over (partition by tree order by pos) as right_hash from nodes) where pos % 2 = 0 and n > 1)
        select l.tree, r.root, l.size from (select tree, count(*) as size from leaves group by 1) l join (select tree, arg_max(hash, level) as root from nodes where n = 1 group by 1) r using (tree)""",
    "merkle_proof": f"""with recursive {_leaves},
        nodes as (select 0 as level, pos, hash, count(*) over () as n from leaves where tree = '1'
          union all select level + 1, pos // 2, coalesce(sha256(unhex('01') || unhex(hash) || unhex(right_hash)), hash), (n + 1) // 2 from (
            select *, lead(hash) over (order by pos) as right_hash from nodes) where pos % 2 = 0 and n > 1)
        select row_number() over (order by level) - 1 as step, hash, if((5 >> level) % 2 = 1, 'left', 'right') as side from nodes where pos = xor(5 >> level, 1) and n > 1""",
    "hash_chain": """
        with rows as (select user_id::varchar as session_key, row_number() over (partition by user_id order by event_id) as n, event_id as id, event_type as t, epoch_us(ts) // 1000 as ms from events),
        lines as (select session_key, n, '{"payload":{"actor":null,"argsDigest":null,"callId":null,"detail":null,"durationMs":null,"filesRead":[],"filesWritten":["/e/' || id || '"],"flags":["' || t || '"],"kind":"' || t
            || '","network":[],"sessionId":"user-' || session_key || '","severity":"info","sourceSeq":' || id || ',"sourceType":"events","status":null,"step":null,"summary":"event ' || id || '","toolName":null,"ts":' || ms || ',"turn":1},"prevHash":' as head,
            ',"recordId":' || n || '}' as tail from rows)
        select session_key, count(*) as records, list_reduce(list({'h': head, 't': tail, 'x': ''} order by n), lambda a, r: {'h': '', 't': '', 'x': sha256(a.x || chr(10) || r.h || if(a.x = '', 'null', '"' || a.x || '"') || r.t || chr(10))}, {'h': '', 't': '', 'x': ''}).x as last_hash
        from lines group by session_key""",
    "chain_verify": _sql("""select session_key as doc, count(*) as records, 0::bigint as issues, 0 as listed,
        (['info', 'low', 'medium', 'high', 'critical'])[max(list_position(['info', 'low', 'medium', 'high', 'critical'], severity))] as max_severity from payloads group by session_key""", _payloads),
    "prefix_metadata_scan": """select conv_id, turn, role as meta_type, turn as meta_seq from conversations""",
    "sensitive_paths": r"""select doc_id, case when regexp_matches(text, '(?i)(^|[\\/])\.env(\..*)?\z') then 'sensitive-path:dotenv' when regexp_matches(text, '(?i)(^|[\\/])id_(rsa|dsa|ecdsa|ed25519)(\.pub)?\z') then 'sensitive-path:ssh-key'
        when regexp_matches(text, '(?i)(^|[\\/])\.(ssh|aws|gnupg|docker)[\\/]') then 'sensitive-path:credential-dir' when regexp_matches(text, '(?i)(^|[\\/])\.npmrc\z') then 'sensitive-path:npmrc'
        when regexp_matches(text, '(?i)(^|[\\/])\.git-credentials\z') then 'sensitive-path:git-credentials' when regexp_matches(text, '(?i)(^|[\\/])\.git[\\/]config\z') then 'sensitive-path:git-config'
        when regexp_matches(text, '(?i)\.(pem|pfx|p12|key|keystore|jks)\z') then 'sensitive-path:key-material' when regexp_matches(text, '(?i)(secret|credential|passwd|password|apikey|api_key|access_token)') then 'sensitive-path:secret-named'
        when regexp_matches(text, '(?i)(^|[\\/])\.dsh[\\/]profiles[\\/]') then 'sensitive-path:dsh-profile' else '' end as flag,
      array_to_string(list_filter([
        case when regexp_matches(text, '(?i)\brm\s+(-[a-z]*r[a-z]*f|-[a-z]*f[a-z]*r)\b') then 'rm-recursive-force' end, case when regexp_matches(text, '(?i)\bRemove-Item\b[^\n]*-Recurse\b[^\n]*-Force\b') then 'remove-item-recursive' end,
        case when regexp_matches(text, '(?i)\b(Format-Volume|format\s+[a-z]:)') then 'format-volume' end, case when regexp_matches(text, '(?i)\bgit\s+reset\s+--hard\b') then 'git-reset-hard' end,
        case when regexp_matches(text, '(?i)\bgit\s+clean\s+-[a-z]*f') then 'git-clean-force' end, case when regexp_matches(text, '(?i)\b(DROP\s+(TABLE|DATABASE)|TRUNCATE\s+TABLE)\b') then 'sql-destructive' end,
        case when regexp_matches(text, '(?i)\b(npm|pnpm|yarn)\s+publish\b') then 'package-publish' end, case when regexp_matches(text, '(?i)\bgit\s+push\b[^\n]*--force\b') then 'git-push-force' end,
        case when regexp_matches(text, '(?i)\b(shutdown|Stop-Computer|Restart-Computer)\b') then 'host-power' end, case when regexp_matches(text, '(?i)[>]{1,2}\s*[A-Za-z]:[\\/](Windows|Program Files)') then 'system-path-write' end,
        case when regexp_matches(text, '(?i)\bcurl\b[^\n]*\|\s*(ba|z|fi)?sh\b') then 'pipe-to-shell' end, case when regexp_matches(text, '(?i)\b(Invoke-Expression|iex)\b') then 'invoke-expression' end], lambda x: x is not null), ',') as destroys
      from documents""",
    # The verdicts on RISK_CASES and DELETE_CASES in their order, read off the rules by hand.
    "risk_patterns": """select p_partkey::bigint as key, (['sensitive-path:dotenv', 'sensitive-path:dotenv', 'sensitive-path:ssh-key', 'sensitive-path:ssh-key', 'sensitive-path:credential-dir', 'sensitive-path:npmrc', 'sensitive-path:git-credentials',
        'sensitive-path:git-config', 'sensitive-path:key-material', 'sensitive-path:secret-named', 'sensitive-path:dsh-profile', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', ''])[p_partkey % 28 + 1] as flag,
      (['', '', '', '', '', '', '', '', '', '', '', '', '', 'rm-recursive-force', 'rm-recursive-force', 'remove-item-recursive', 'format-volume', 'git-reset-hard', 'git-clean-force', 'sql-destructive', 'sql-destructive', 'package-publish',
        'git-push-force', 'host-power', 'system-path-write', 'pipe-to-shell', 'invoke-expression', ''])[p_partkey % 28 + 1] as destroys from part""",
    "delete_targets": """select key, severity, 'destructive:' || flag as flag from (select p_partkey::bigint as key, (['high', 'high', 'critical', 'high', 'critical', 'critical', 'high', 'high', 'critical', 'high', 'critical', 'critical', 'critical', 'critical'])[p_partkey % 14 + 1] as severity,
      (['in-workspace', 'in-workspace', 'workspace-root', 'in-workspace', 'system-target', 'outside-workspace', 'target-unresolved', 'in-workspace', 'outside-workspace', 'in-workspace', 'system-target', 'system-target', 'outside-workspace', 'system-target'])[p_partkey % 14 + 1] as flag from part)""",
}

#: Through real logs the calls are the same.
ORACLE["log_round_trip"] = ORACLE["tool_call_stats"]
