"""The same results in plain SQL over the same tables, written without the library."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """What the SQL shows of a built-in rule."""

    rule_id: str
    name: str
    severity: str
    explanation: str
    investigation_steps: tuple[str, ...]
    tags: tuple[str, ...]


# Ids and texts of the built-in rules.
POWERSHELL_PROCESS = Rule(
    "TP-WIN-SYSMON-0001",
    "PowerShell Process Execution",
    "low",
    "PowerShell executed on the monitored host. PowerShell is a legitimate administrative tool, but attackers also use it for scripting, payload execution, and remote administration.",
    (
        "Review the full command line.",
        "Identify the parent process.",
        "Confirm the user expected to run PowerShell.",
        "Check for related network or authentication activity.",
    ),
    (
        "windows",
        "sysmon",
        "powershell",
        "process_creation",
    ),
)
ENCODED_POWERSHELL = Rule(
    "TP-WIN-SYSMON-0002",
    "Encoded PowerShell Command",
    "medium",
    "PowerShell started with an encoded-command option. Encoding can be legitimate, but it is frequently used to obscure the contents of scripts or commands from casual inspection.",
    (
        "Capture and decode the encoded command without executing it.",
        "Review the parent process and initiating user.",
        "Check whether the command contacted external systems.",
        "Search for additional encoded PowerShell activity on the host.",
    ),
    (
        "windows",
        "sysmon",
        "powershell",
        "encoded_command",
        "process_creation",
    ),
)
ENCODED_EXECUTION = Rule(
    "TP-CORR-WIN-0001",
    "Encoded PowerShell Execution",
    "medium",
    "The same process-creation event matched both the general PowerShell execution rule and the encoded-command rule.",
    (
        "Decode the command without executing it.",
        "Review the parent process and initiating user.",
        "Determine whether the command belongs to approved software.",
        "Search for related process and network activity.",
    ),
    (
        "windows",
        "powershell",
        "encoded_command",
        "same_event",
    ),
)
REPEATED_ENCODED = Rule(
    "TP-CORR-WIN-0002",
    "Repeated Encoded PowerShell Activity",
    "high",
    "Multiple encoded PowerShell processes executed on the same host within a short period. Repetition increases the chance that the activity represents automation, persistence, or malicious command execution.",
    (
        "Compare the encoded command payloads.",
        "Identify the user and parent process for each execution.",
        "Review network connections around the event times.",
        "Check whether a scheduled task or management tool initiated them.",
    ),
    (
        "windows",
        "powershell",
        "encoded_command",
        "repeated_activity",
    ),
)

# ---------------------------------------------------------------- building blocks


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def uuid(kind: str, key: str) -> str:
    digest = f"sha256('{kind}|' || {key})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "(" + " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in cuts) + ")"


def commit(moment: str) -> str:
    return f"(date_trunc('hour', {moment}) + INTERVAL 1 HOUR)"


def time_text(moment: str) -> str:
    return (
        f"CASE WHEN epoch_us({moment}) % 1000000 = 0 THEN strftime({moment}, '%Y-%m-%d %H:%M:%S') "
        f"ELSE strftime({moment}, '%Y-%m-%d %H:%M:%S.%f') END"
    )


def telemetry(from_xml: bool = False) -> str:
    """Telemetry rows; read back from XML some hosts and levels take their defaults."""
    host = "'HOST-' || lpad(CAST(user_id % 5 AS VARCHAR), 2, '0')"
    level = "CAST(event_id % 7 AS VARCHAR)"
    if from_xml:
        host = f"CASE WHEN event_id % 17 = 0 THEN 'COLLECTOR' ELSE {host} END"
        level = f"CASE WHEN event_id % 13 = 0 THEN '4' ELSE {level} END"
    return rf"""
t0 AS (
  SELECT {host} AS source_host,
    CASE event_type WHEN 'error' THEN 'sysmon' WHEN 'click' THEN 'sysmon' WHEN 'view' THEN 'windows_system'
      WHEN 'signup' THEN 'windows_security' WHEN 'purchase' THEN 'powershell' END AS source_type,
    event_id AS record_id, event_id AS arrival_seq, {level} AS level,
    CAST(event_id % 7 AS VARCHAR) AS sent_level, ts AS time_created,
    CASE WHEN event_type <> 'error' THEN 'C:\Windows\System32\notepad.exe'
      WHEN event_id % 3 = 0 THEN 'C:\Program Files\PowerShell\7\pwsh.exe'
      ELSE 'C:\Windows\System32\WindowsPowerShell\v1.0\PowerShell.EXE' END AS image,
    CASE event_id % 4 WHEN 0 THEN 'powershell.exe -EncodedCommand SQBFAFgA'
      WHEN 1 THEN 'powershell.exe "-ENC" SQBF' WHEN 2 THEN 'powershell.exe Get-Process'
      ELSE 'powershell.exe -encx no' END AS command_line,
    '{{' || CAST(event_id AS VARCHAR) || '}}' AS process_guid,
    CAST(1000 + event_id % 5000 AS VARCHAR) AS process_id,
    'CORP\user' || CAST(user_id AS VARCHAR) AS user_name,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE sha256(CAST(event_id AS VARCHAR)) END AS sha,
    'MD5=' || md5(props) || CASE WHEN event_id % 11 = 0 THEN ''
      WHEN event_id % 2 = 0 THEN ',SHA256=' || sha256(CAST(event_id AS VARCHAR))
      ELSE ', sha256=' || sha256(CAST(event_id AS VARCHAR)) END AS hashes,
    value
  FROM events),
tel AS (
  SELECT *,
    CASE source_type WHEN 'sysmon' THEN 'Microsoft-Windows-Sysmon'
      WHEN 'windows_system' THEN 'Service Control Manager'
      WHEN 'windows_security' THEN 'Microsoft-Windows-Security-Auditing'
      ELSE 'Microsoft-Windows-PowerShell' END AS provider,
    CAST(CASE WHEN source_type = 'sysmon' THEN CASE WHEN record_id % 7 = 0 THEN 3 ELSE 1 END
      WHEN source_type = 'windows_system' THEN 7036 WHEN source_type = 'windows_security' THEN 4624
      ELSE 4104 END AS BIGINT) AS event_id,
    CASE WHEN source_type = 'sysmon' THEN 'Microsoft-Windows-Sysmon/Operational'
      WHEN source_type = 'windows_system' THEN 'System' WHEN source_type = 'windows_security' THEN 'Security'
      WHEN record_id % 2 = 0 THEN 'Windows PowerShell'
      ELSE 'Microsoft-Windows-PowerShell/Operational' END AS channel,
    CASE level WHEN '0' THEN 'LogAlways' WHEN '1' THEN 'Critical' WHEN '2' THEN 'Error' WHEN '3' THEN 'Warning'
      WHEN '4' THEN 'Information' WHEN '5' THEN 'Verbose' ELSE level END AS severity,
    'ProcessGuid=' || process_guid || ' ProcessId=' || process_id || ' Image=' || image || ' CommandLine='
      || command_line || ' ParentImage=C:\Windows\explorer.exe ParentCommandLine=explorer.exe User='
      || user_name || ' Hashes=' || hashes AS message
  FROM t0)"""


EVENT_JSON = r"""json_object('CommandLine', command_line, 'Hashes', hashes, 'Image', image,
  'ParentCommandLine', 'explorer.exe', 'ParentImage', 'C:\Windows\explorer.exe',
  'ProcessGuid', process_guid, 'ProcessId', process_id, 'User', user_name)"""

RAW_JSON = f"""CAST(json_object('computer', source_host, 'event_data', {EVENT_JSON}, 'event_id', event_id,
  'level', level, 'provider', provider, 'record_id', record_id, 'user_data', json_object()) AS VARCHAR)"""

LOGS = f"""
logs AS (
  SELECT source_host, source_type, provider AS provider_name, event_id, record_id AS event_record_id, severity,
    time_created, message, {RAW_JSON} AS raw_data, {commit('time_created')} AS inserted_at
  FROM tel)"""

PROCESSES = rf"""
processes AS (
  SELECT source_host, process_guid, CAST(process_id AS BIGINT) AS process_id, image, command_line,
    'C:\Windows\explorer.exe' AS parent_image, 'explorer.exe' AS parent_command_line, user_name, sha AS sha256,
    time_created AS created_at, {commit('time_created')} AS inserted_at
  FROM tel WHERE source_type = 'sysmon' AND event_id = 1)"""

METRICS = """
metrics AS (
  SELECT 'HOST-' || lpad(CAST(user_id % 5 AS VARCHAR), 2, '0') AS host_name, value % 100 AS cpu_percent,
    (value * 7) % 100 AS memory_percent, (value * 13) % 100 AS disk_percent,
    CAST(date_trunc('day', ts) AS TIMESTAMP) AS boot_time, ts AS collected_at, event_type
  FROM events)"""

RUNS = """
runs AS (
  SELECT source_host, CASE WHEN sum(CASE WHEN severity = 'Critical' THEN 1 ELSE 0 END) > count(*) / 2.0
      THEN 'failed' ELSE 'success' END AS status,
    CAST(count(*) AS INTEGER) AS events_inserted, date_trunc('hour', time_created) AS started_at,
    max(time_created) AS finished_at,
    CASE WHEN sum(CASE WHEN severity = 'Critical' THEN 1 ELSE 0 END) > count(*) / 2.0
      THEN 'too many critical events' END AS error_message
  FROM tel GROUP BY source_host, date_trunc('hour', time_created))"""

_IS_POWERSHELL = (
    "source_type = 'sysmon' AND event_id = 1 AND (lower(image) LIKE '%powershell.exe' OR lower(image) LIKE '%pwsh.exe')"
)
_IS_ENCODED = (
    "list_has_any(list_transform(string_split_regex(lower(command_line), '\\s+'), lambda x: trim(x, '\"''(),;')), "
    "['-enc', '-encodedcommand', '/enc', '/encodedcommand'])"
)


def _finding_part(rule, condition: str, evidence: str) -> str:
    return f"""
  SELECT {text(rule.rule_id)} AS rule_id, 1 AS rule_version, {text(rule.name)} AS title,
    {text(rule.severity)} AS severity, source_host, source_type, event_id, record_id AS event_record_id,
    time_created AS event_time, {commit('time_created')} AS evaluated_at, {text(rule.explanation)} AS explanation,
    {text_list(rule.investigation_steps)} AS investigation_steps, {evidence} AS evidence,
    {text_list(rule.tags)} AS tags, {commit('time_created')} AS created_at, arrival_seq
  FROM tel WHERE {condition}"""


KEY = "concat_ws('|', source_host, source_type, event_id, event_record_id, rule_id, rule_version)"

FINDINGS = f"""
f0 AS ({_finding_part(POWERSHELL_PROCESS, _IS_POWERSHELL,
    "CAST(json_object('raw.event_data.Image', image) AS VARCHAR)")}
  UNION ALL {_finding_part(ENCODED_POWERSHELL, f"{_IS_POWERSHELL} AND {_IS_ENCODED}",
    "CAST(json_object('raw.event_data.Image', image, 'raw.event_data.CommandLine', command_line) AS VARCHAR)")}),
f AS (
  SELECT *, {KEY} AS event_key,
    {uuid('finding', "concat_ws('|', rule_id, rule_version, source_host, source_type, event_id, event_record_id)")}
      AS finding_uuid
  FROM f0)"""

FINDING_COLUMNS = """finding_uuid, rule_id, rule_version, title, severity, source_host, source_type, event_id,
  event_record_id, event_time, evaluated_at, explanation, CAST(to_json(investigation_steps) AS VARCHAR)
  AS investigation_steps, evidence, CAST(to_json(tags) AS VARCHAR) AS tags"""


def pairs(name: str, rule_id: str, window: int, look_back: int | None, detection: str = "TP-WIN-SYSMON-0002") -> str:
    """Greedy windows of two findings per host, closed form.

    A window may end at row i when row i-1 is at most ``window`` older. Within a run of such
    rows every second one ends a window, from the first of the run or, with a look-back, from
    the second row of the look-back of i if that comes later.
    """
    oldest = "1" if look_back is None else (
        "i - count(*) OVER (PARTITION BY source_host ORDER BY event_time RANGE BETWEEN INTERVAL "
        f"{look_back} SECOND PRECEDING AND CURRENT ROW) + 1"
    )
    return f"""
{name}_rows AS (
  SELECT *, row_number() OVER w AS i, lag(event_time) OVER w AS before_time, lag(finding_uuid) OVER w AS before_id,
    lag(event_key) OVER w AS before_key
  FROM f WHERE rule_id = '{detection}' WINDOW w AS (PARTITION BY source_host ORDER BY event_time, arrival_seq)),
{name}_ends AS (
  SELECT *, {oldest} AS oldest,
    coalesce(epoch_us(event_time) - epoch_us(before_time) <= {window}000000, false) AS fits FROM {name}_rows),
{name}_runs AS (
  SELECT *, max(CASE WHEN NOT fits THEN i END) OVER (PARTITION BY source_host ORDER BY i) + 1 AS run_start
  FROM {name}_ends),
{name} AS (
  SELECT '{rule_id}' AS rule_id, source_host, before_time AS first_event_time, event_time AS last_event_time,
    [before_id, finding_uuid] AS ids, ['{detection}', '{detection}'] AS rule_ids,
    list_sort([before_key, event_key]) AS keys,
    '{{"finding_count":2,"group_key":["' || source_host || '"],"window_seconds":{window}}}' AS evidence
  FROM {name}_runs WHERE fits AND i >= greatest(run_start, oldest + 1) AND (i - greatest(run_start, oldest + 1)) % 2 = 0)"""


def late_pairs(name: str, rule_id: str, window: int, arrival: str) -> str:
    """Anchored windows of two when findings arrive in another order than they happened (window = look-back)."""
    return f"""
{name}_rows AS (SELECT *, {arrival} AS seen FROM f WHERE rule_id = 'TP-WIN-SYSMON-0002'),
{name}_looks AS (
  SELECT a.source_host, a.finding_uuid, a.event_time, a.event_key, count(*) AS n,
    max(b.event_time) FILTER (WHERE b.event_time < a.event_time) AS before_time,
    arg_max(b.finding_uuid, b.event_time) FILTER (WHERE b.event_time < a.event_time) AS before_id,
    arg_max(b.event_key, b.event_time) FILTER (WHERE b.event_time < a.event_time) AS before_key
  FROM {name}_rows a JOIN {name}_rows b ON a.source_host = b.source_host AND b.seen <= a.seen
    AND b.event_time BETWEEN a.event_time - INTERVAL {window} SECOND AND a.event_time
  GROUP BY ALL),
{name} AS (
  SELECT '{rule_id}' AS rule_id, source_host, before_time AS first_event_time, event_time AS last_event_time,
    [before_id, finding_uuid] AS ids, list_sort([before_key, event_key]) AS keys
  FROM {name}_looks WHERE n % 2 = 0)"""


SAME = """
same AS (
  SELECT 'TP-CORR-WIN-0001' AS rule_id, a.source_host, a.event_time AS first_event_time,
    b.event_time AS last_event_time, [a.finding_uuid, b.finding_uuid] AS ids,
    ['TP-WIN-SYSMON-0001', 'TP-WIN-SYSMON-0002'] AS rule_ids, list_sort([a.event_key, b.event_key]) AS keys,
    '{"finding_count":2,"group_key":["' || a.source_host || '",' || a.event_record_id || ']}' AS evidence
  FROM f a JOIN f b ON a.source_host = b.source_host AND a.event_record_id = b.event_record_id
  WHERE a.rule_id = 'TP-WIN-SYSMON-0001' AND b.rule_id = 'TP-WIN-SYSMON-0002')"""


def keyed(source: str) -> str:
    """Correlation key and id of match rows."""
    key = "sha256(rule_id || '|1|' || source_host || '|' || array_to_string(keys, '|'))"
    return f"(SELECT *, {key} AS correlation_key, {uuid('correlation', key)} AS correlation_uuid FROM {source})"


def _by_rule(attribute) -> str:
    a, b = (attribute(rule) for rule in (ENCODED_EXECUTION, REPEATED_ENCODED))
    return f"CASE rule_id WHEN 'TP-CORR-WIN-0001' THEN {a} ELSE {b} END"


def chain(repeated: str) -> str:
    """Matches, assessments and alerts of the built-in rules."""
    evidence = "{'correlation_severity': severity, 'correlation_title': title, 'matched_finding_ids': ids}"
    item = (
        "[{'provider': 'repeated_activity', 'reason': 'Repeated encoded PowerShell activity occurred within the "
        "correlation window.', 'score_delta': 15, 'evidence': '{\"correlation_rule_id\":\"TP-CORR-WIN-0002\","
        "\"finding_count\":2}'}]"
    )
    return f"""
{SAME}, {repeated},
matches AS (
  SELECT *, 1 AS rule_version, {_by_rule(lambda r: text(r.name))} AS title,
    {_by_rule(lambda r: text(r.severity))} AS severity, {_by_rule(lambda r: text(r.explanation))} AS explanation,
    {_by_rule(lambda r: text_list(r.investigation_steps))} AS investigation_steps,
    {_by_rule(lambda r: text_list(r.tags))} AS tags, {commit('last_event_time')} AS created_at
  FROM {keyed('(SELECT * FROM same UNION ALL SELECT * FROM repeated)')}),
risks AS (
  SELECT {uuid('assessment', 'correlation_uuid')} AS assessment_uuid, correlation_uuid,
    rule_id AS correlation_rule_id, CASE rule_id WHEN 'TP-CORR-WIN-0001' THEN 40 ELSE 80 END AS score,
    CASE rule_id WHEN 'TP-CORR-WIN-0001' THEN 'medium' ELSE 'critical' END AS level,
    CASE rule_id WHEN 'TP-CORR-WIN-0001' THEN 40 ELSE 65 END AS base_score,
    CASE rule_id WHEN 'TP-CORR-WIN-0001' THEN '[]' ELSE CAST(to_json({item}) AS VARCHAR) END AS contributions,
    source_host, first_event_time, last_event_time, created_at AS assessed_at,
    CASE rule_id WHEN 'TP-CORR-WIN-0001'
      THEN 'Risk score 40 (medium) derived from base score 40 and 0 contribution(s).'
      ELSE 'Risk score 80 (critical) derived from base score 65 and 1 contribution(s).' END AS explanation,
    CAST(to_json({evidence}) AS VARCHAR) AS evidence, created_at
  FROM matches),
alerts AS (
  SELECT {uuid('alert', 'assessment_uuid')} AS alert_uuid, assessment_uuid, correlation_uuid, correlation_rule_id,
    upper(level[1]) || level[2:] || ' Risk Activity on ' || source_host AS title, score AS risk_score,
    level AS risk_level, 'new' AS status, source_host, first_event_time, last_event_time, created_at,
    'Risk assessment ' || assessment_uuid || ' produced score ' || score || '/100 (' || level || ').' AS summary,
    '{{"base_score":' || base_score || ',"contribution_count":'
      || CASE correlation_rule_id WHEN 'TP-CORR-WIN-0001' THEN '0' ELSE '1' END
      || ',"risk_evidence":' || evidence || '}}' AS evidence, created_at AS inserted_at
  FROM risks)"""


REPEATED = pairs("repeated", "TP-CORR-WIN-0002", 600, 600)
CHAIN = f"{telemetry()}, {FINDINGS}, {chain(REPEATED)}"

MATCH_IDS = """correlation_uuid, rule_id, source_host, first_event_time, last_event_time,
  CAST(to_json(ids) AS VARCHAR) AS matched_finding_ids"""


def over(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def on_telemetry(select: str) -> str:
    return over(telemetry(), select)


def on_documents(select: str) -> str:
    return over(telemetry(from_xml=True), select)


def on_findings(select: str) -> str:
    return over(f"{telemetry()}, {FINDINGS}", select)


def on_pairs(body: str, name: str) -> str:
    return over(f"{telemetry()}, {FINDINGS}, {body}", f"SELECT {MATCH_IDS} FROM {keyed(name)}")


def on_chain(select: str) -> str:
    return over(CHAIN, select)


def on_logs(select: str) -> str:
    return over(f"{telemetry()}, {LOGS}", select)


def on_processes(select: str) -> str:
    return over(f"{telemetry()}, {PROCESSES}", select)


ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- sources and sinks

LOG_COLUMNS = (
    "source_host, source_type, provider_name, event_id, event_record_id, severity, time_created, message, raw_data, inserted_at"
)
_LAST = """last AS (
  SELECT source_type, channel, CASE channel WHEN 'System' THEN 0 WHEN 'Windows PowerShell' THEN max(record_id) + 1000
    ELSE max(record_id) // 2 END AS last_record_id FROM tel GROUP BY source_type, channel)"""
_BAD = "(channel = 'System' AND (record_id % 23 = 0 OR record_id % 29 = 0))"
_ORDINAL = """CASE channel WHEN 'System' THEN 0 WHEN 'Application' THEN 1 WHEN 'Security' THEN 2
  WHEN 'Microsoft-Windows-Sysmon/Operational' THEN 3 WHEN 'Windows PowerShell' THEN 4 ELSE 5 END"""

ORACLES["s01_xml_scan"] = on_documents(
    "SELECT provider, CAST(event_id AS VARCHAR) AS event_id, record_id, "
    "CASE WHEN source_type = 'windows_security' THEN 0 ELSE 8 END AS data_nodes FROM tel"
)
ORACLES["s02_after_checkpoint"] = over(
    f"{telemetry()}, {_LAST}",
    "SELECT t.source_type, t.channel, t.record_id FROM tel t JOIN last l USING (source_type, channel) "
    "WHERE last_record_id = 0 OR record_id > last_record_id",
)
_HOST_LAST = """last AS (
  SELECT source_host, source_type, channel, CASE WHEN source_host = 'HOST-00' THEN 0 ELSE max(record_id) // 2 END AS last_record_id
  FROM tel GROUP BY source_host, source_type, channel)"""
ORACLES["s02b_after_host_checkpoint"] = over(
    f"{telemetry()}, {_HOST_LAST}",
    "SELECT t.source_host, t.source_type, t.channel, t.record_id FROM tel t JOIN last l USING (source_host, source_type, channel) "
    "WHERE last_record_id = 0 OR record_id > last_record_id",
)
ORACLES["s02c_limited_batches"] = over(
    f"""{telemetry(from_xml=True)},
numbered AS (
  SELECT *, {_BAD} AS bad, rank() OVER (PARTITION BY source_type, channel, {_BAD} ORDER BY record_id) AS place,
    (SELECT count(*) FROM tel) // 20 AS size FROM tel),
placed AS (SELECT bad, CASE WHEN bad OR place <= size THEN 0 ELSE 1 END AS batch_id FROM numbered)""",
    "SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) FILTER (NOT bad) AS stored, count(*) FILTER (bad) AS rejected FROM placed GROUP BY batch_id",
)
ORACLES["s04b_advance_host_checkpoints"] = over(
    f"{telemetry()}, {_HOST_LAST}, seen AS (SELECT source_host, source_type, channel, max(record_id) AS seen FROM tel WHERE record_id % 3 = 0 GROUP BY ALL)",
    "SELECT source_host, source_type, channel, greatest(last_record_id, coalesce(seen, 0)) AS last_record_id "
    "FROM last LEFT JOIN seen USING (source_host, source_type, channel)",
)
ORACLES["s11b_repeated_batches"] = on_telemetry(
    "SELECT source_type, count(*) + count(*) FILTER (record_id % 2 = 0) AS events FROM tel GROUP BY source_type"
)
ORACLES["s03_next_batch"] = on_telemetry(
    "SELECT source_type, channel, record_id FROM tel "
    "QUALIFY row_number() OVER (PARTITION BY source_type, channel ORDER BY record_id) <= 100"
)
ORACLES["s04_advance_checkpoints"] = over(
    f"{telemetry()}, {_LAST}",
    "SELECT source_type, channel, greatest(last_record_id, max(record_id)) AS last_record_id "
    "FROM tel JOIN last USING (source_type, channel) GROUP BY source_type, channel, last_record_id",
)
ORACLES["s05_load_checkpoints"] = on_telemetry(
    "SELECT source_type, channel, max(record_id) AS last_record_id FROM tel "
    "WHERE channel NOT IN ('System', 'Security') GROUP BY source_type, channel"
)
ORACLES["s06_enabled_sources"] = on_telemetry(
    "SELECT source_type, channel, CASE channel WHEN 'Windows PowerShell' THEN 0 "
    "WHEN 'Microsoft-Windows-PowerShell/Operational' THEN 1 ELSE 2 END AS ordinal, count(*) AS events FROM tel "
    "WHERE source_type IN ('sysmon', 'powershell') GROUP BY source_type, channel"
)
ORACLES["s07_append_log_events"] = on_logs(f"SELECT {LOG_COLUMNS} FROM logs")
ORACLES["s08_append_process_events"] = on_processes("SELECT * FROM processes")
ORACLES["s09_append_host_metrics"] = over(
    METRICS,
    "SELECT host_name, cpu_percent, memory_percent, disk_percent, boot_time, collected_at FROM metrics "
    "WHERE event_type <> 'view'",
)
ORACLES["s10_run_audit"] = on_documents(
    f"SELECT 'COLLECTOR' AS source_host, 'success' AS status, CAST(count(*) FILTER (NOT {_BAD}) AS INTEGER) "
    f"AS events_inserted, count(*) FILTER ({_BAD}) AS rejected_count, CAST(NULL AS VARCHAR) AS error_message "
    "FROM tel, (VALUES (0), (1)) batches(b) GROUP BY b"
)
ORACLES["s11_committed_batches"] = on_documents(
    f"SELECT source_type, 2 * count(*) AS events FROM tel WHERE NOT {_BAD} GROUP BY source_type"
)
ORACLES["s12_channel_isolation"] = on_documents(
    f"SELECT source_type, channel, count(*) AS documents, count(*) FILTER (NOT {_BAD}) AS stored, "
    f"CASE WHEN bool_or({_BAD}) THEN 0 ELSE count(*) END AS stored_strict FROM tel GROUP BY source_type, channel"
)
ORACLES["s13_arrival_order"] = on_telemetry(
    f"SELECT source_type, channel, record_id, row_number() OVER (ORDER BY {_ORDINAL}, record_id) - 1 AS arrival_seq FROM tel"
)
ORACLES["s14_stored_intelligence"] = on_chain(
    "SELECT count(*) AS stored_rows, 'detection_findings' AS table_name FROM f UNION ALL "
    "SELECT count(*), 'correlation_matches' FROM matches UNION ALL SELECT count(*), 'risk_assessments' FROM risks "
    "UNION ALL SELECT count(*), 'alerts' FROM alerts"
)

# ---------------------------------------------------------------- normalization

_XML_MESSAGE = (
    "CASE WHEN source_type = 'windows_security' THEN 'LogFileCleared={''SubjectUserName'': ''' || "
    "replace(user_name, '\\', '\\\\') || ''', ''Code'': ''00' || sent_level || '''}' ELSE message END"
)
ORACLES["n01_parse_events"] = on_documents(
    "SELECT provider, event_id, record_id, severity, time_created, source_host AS computer, source_type, channel, "
    f"{_XML_MESSAGE} AS message, false AS is_bad FROM tel"
)
ORACLES["n02_element_defaults"] = on_documents("SELECT record_id, level, source_host AS computer FROM tel")
ORACLES["n03_provider_default"] = on_documents(
    "SELECT CASE WHEN source_type = 'windows_system' THEN '' ELSE provider END AS provider, count(*) AS events "
    "FROM tel GROUP BY ALL"
)
ORACLES["n04_event_data"] = on_documents(
    "SELECT record_id, CASE WHEN source_type = 'windows_security' THEN '{}' ELSE CAST(json_object("
    "'ProcessGuid', process_guid, 'User', user_name, 'Data2', image, 'CommandLine', command_line, "
    "'Data4', 'C:\\Windows\\explorer.exe', 'ParentCommandLine', 'explorer.exe', 'Hashes', hashes) AS VARCHAR) END "
    "AS event_data FROM tel"
)
ORACLES["n05_user_data"] = on_documents(
    "SELECT record_id, CASE WHEN source_type = 'windows_security' THEN CAST(json_object('LogFileCleared', "
    "json_object('Code', '00' || sent_level, 'SubjectUserName', user_name)) AS VARCHAR) ELSE '{}' END AS user_data FROM tel"
)
ORACLES["n06_message"] = on_documents(f"SELECT record_id, {_XML_MESSAGE} AS message FROM tel")
ORACLES["n07_severity"] = on_documents("SELECT severity, count(*) AS events FROM tel GROUP BY severity")
ORACLES["n08_event_time"] = on_documents(
    "SELECT record_id, CASE WHEN record_id % 19 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE time_created END "
    "AS time_created FROM tel"
)
ORACLES["n09_strict_numbers"] = on_documents(
    "SELECT arrival_seq, CASE WHEN arrival_seq % 5 <> 0 THEN CAST(record_id AS VARCHAR) END AS record_id, arrival_seq % 5 = 0 AS is_bad FROM tel"
)
ORACLES["n10_raw_json"] = on_telemetry(f"SELECT record_id, {RAW_JSON} AS raw_data FROM tel")
ORACLES["n11_process_events"] = over(f"{telemetry(from_xml=True)}, {PROCESSES}", "SELECT * FROM processes")
ORACLES["n12_sha256"] = on_telemetry("SELECT record_id, sha AS sha256 FROM tel")
ORACLES["n13_host_fallback"] = on_telemetry(
    "SELECT 'log' AS kind, CASE WHEN record_id % 3 = 0 THEN 'COLLECTOR' ELSE source_host END AS source_host, "
    "count(*) AS events FROM tel GROUP BY ALL UNION ALL "
    "SELECT 'process', CASE WHEN record_id % 3 = 0 THEN '' ELSE source_host END, count(*) FROM tel "
    "WHERE source_type = 'sysmon' AND event_id = 1 GROUP BY ALL"
)
ORACLES["n14_malformed_documents"] = on_documents(
    "SELECT arrival_seq, source_type, channel, CASE WHEN record_id % 23 = 0 THEN '0' END AS event_id, "
    f"CASE WHEN record_id % 23 = 0 THEN 0 ELSE record_id END AS record_id FROM tel WHERE {_BAD}"
)
ORACLES["n15_json_values"] = on_chain("SELECT alert_uuid, evidence FROM alerts")

# ---------------------------------------------------------------- detection

_ELIGIBLE = "source_type = 'sysmon' AND event_id = 1"
_IMAGE_JSON = "CAST(json_object('raw.event_data.Image', image) AS VARCHAR) AS evidence"
_COMMAND_JSON = "CAST(json_object('raw.event_data.CommandLine', command_line) AS VARCHAR) AS evidence"


def records(evidence: str, condition: str) -> str:
    return on_telemetry(f"SELECT record_id, {evidence} FROM tel WHERE {_ELIGIBLE} AND {condition}")


ORACLES["d01_all_rules"] = on_findings(f"SELECT {FINDING_COLUMNS}, created_at, arrival_seq FROM f")
ORACLES["d02_eligibility"] = on_telemetry(
    f"SELECT source_type, count(*) FILTER ({_ELIGIBLE}) AS tp_win_sysmon_0001, "
    "count(*) FILTER (source_type = 'sysmon' AND event_id = 3) AS t_0003, "
    "count(*) FILTER (source_type = 'windows_system' AND event_id = 7036) AS t_7036, "
    "CAST(0 AS BIGINT) AS t_off, CAST(0 AS BIGINT) AS t_none FROM tel GROUP BY source_type"
)
ORACLES["d03_field_paths"] = on_documents(
    "SELECT record_id, CASE WHEN source_type <> 'windows_security' THEN image END AS image, "
    "CASE WHEN source_type = 'windows_security' THEN user_name END AS user, "
    "CASE WHEN source_type = 'windows_security' THEN '00' || sent_level END AS code, level, "
    "CAST(record_id AS VARCHAR) AS record, CAST(NULL AS VARCHAR) AS missing_key, "
    "CAST(NULL AS VARCHAR) AS missing_field, CAST(NULL AS VARCHAR) AS beyond_text FROM tel"
)
ORACLES["d04_equals"] = records(
    _IMAGE_JSON, "lower(image) IN (lower('C:\\Windows\\System32\\notepad.exe'), lower('C:\\Program Files\\PowerShell\\7\\pwsh.exe'))"
)
ORACLES["d05_contains"] = records(
    _COMMAND_JSON, "contains(lower(command_line), 'powershell') AND contains(lower(command_line), '-enc')"
)
ORACLES["d06_contains_any"] = records(
    _COMMAND_JSON, "(contains(lower(command_line), 'get-') OR contains(lower(command_line), 'sqbf'))"
)
ORACLES["d07_contains_any_token"] = records(_COMMAND_JSON, _IS_ENCODED)
ORACLES["d08_ends_with"] = records(
    _IMAGE_JSON, "ends_with(lower(image), '.exe') AND ends_with(lower(image), 'sh.exe')"
)
ORACLES["d09_ends_with_any"] = records(
    _IMAGE_JSON, "(ends_with(lower(image), '\\pwsh.exe') OR ends_with(lower(image), 'pad.exe'))"
)
ORACLES["d10_null_case_text"] = on_telemetry(
    f"SELECT 'case_kept' AS rule_id, record_id AS event_record_id FROM tel WHERE {_ELIGIBLE} AND ends_with(image, 'PowerShell.EXE') "
    f"UNION ALL SELECT 'case_wrong', record_id FROM tel WHERE {_ELIGIBLE} AND ends_with(image, 'powershell.exe') "
    f"UNION ALL SELECT 'number', record_id FROM tel WHERE {_ELIGIBLE} AND record_id % 10 = 7 "
    f"UNION ALL SELECT 'no_values_all', record_id FROM tel WHERE {_ELIGIBLE}"
)
ORACLES["d11_conjunction_evidence"] = records(
    "CAST(json_object('raw.event_data.Image', image, 'raw.event_data.CommandLine', command_line, 'channel', channel) "
    "AS VARCHAR) AS evidence",
    "contains(lower(image), 'powershell') AND (contains(lower(command_line), 'get') OR contains(lower(command_line), 'enc'))",
)
ORACLES["d12_finding_projection"] = on_findings(
    "SELECT " + uuid("finding", "concat_ws('|', rule_id, rule_version, source_host, source_type, event_id, "
    "CASE WHEN event_record_id IS NULL THEN 'None|' || arrival_seq ELSE CAST(event_record_id AS VARCHAR) END)")
    + " AS finding_uuid, rule_id, source_host, CAST(event_record_id AS VARCHAR) AS event_record_id, event_time, evaluated_at, title FROM ("
    "SELECT * REPLACE (CASE WHEN arrival_seq % 2 = 0 THEN source_host ELSE '' END AS source_host, "
    "CASE WHEN arrival_seq % 9 <> 0 THEN event_record_id END AS event_record_id) FROM f)"
)
for _name, _rule in (("d14_powershell_rule", POWERSHELL_PROCESS), ("d15_encoded_rule", ENCODED_POWERSHELL)):
    ORACLES[_name] = on_findings(
        "SELECT finding_uuid, rule_id, severity, source_host, event_record_id, event_time, "
        f"CAST(to_json(tags) AS VARCHAR) AS tags FROM f WHERE rule_id = '{_rule.rule_id}'"
    )
_TWICE = (
    "(SELECT * FROM f UNION ALL SELECT * REPLACE (arrival_seq + 1000000000 AS arrival_seq) FROM f)"
)
ORACLES["d16_insert_if_new"] = on_findings(
    f"SELECT rule_id, source_host, event_record_id, min(arrival_seq) AS arrival_seq FROM {_TWICE} "
    "WHERE rule_id <> 'TP-WIN-SYSMON-0001' GROUP BY rule_id, source_host, event_record_id"
)
ORACLES["d16b_first_arrivals"] = on_findings(
    f"SELECT rule_id, source_host, CAST(event_record_id AS VARCHAR) AS event_record_id, min(arrival_seq) AS arrival_seq FROM {_TWICE} "
    "WHERE event_record_id % 9 <> 0 GROUP BY rule_id, source_host, event_record_id UNION ALL "
    f"SELECT rule_id, source_host, NULL, arrival_seq FROM {_TWICE} WHERE event_record_id % 9 = 0"
)
ORACLES["d17_recent_findings"] = on_findings(
    "SELECT finding_uuid, event_time, event_record_id FROM f WHERE source_host = 'HOST-02' "
    "AND rule_id IN ('TP-WIN-SYSMON-0002', 'TP-OTHER') "
    "AND event_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' ORDER BY 2, 1"
)
ORACLES["d18_typed_findings"] = on_findings(
    "SELECT finding_uuid, CAST(len(investigation_steps) AS INTEGER) AS steps, "
    "CASE WHEN rule_id = 'TP-WIN-SYSMON-0002' THEN evidence ELSE '{}' END AS evidence, "
    "CAST(to_json(tags) AS VARCHAR) AS tags FROM f"
)

# ---------------------------------------------------------------- correlation

ORACLES["c01_correlate_history"] = over(
    f"{telemetry()}, {FINDINGS}, {SAME}, {pairs('a', 'TP-CORR-WIN-0002', 600, None)}, {pairs('b', 'T-CORR-3600', 3600, None)}",
    "SELECT rule_id, source_host, count(*) AS matches, min(first_event_time) AS first, max(last_event_time) AS last "
    "FROM (SELECT * FROM same UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY rule_id, source_host",
)
ORACLES["c02_same_event"] = on_pairs(SAME, "same")
ORACLES["c03_full_history_600"] = on_pairs(pairs("p", "TP-CORR-WIN-0002", 600, None), "p")
ORACLES["c03_full_history_3600"] = on_pairs(pairs("p", "T-CORR-3600", 3600, None), "p")
ORACLES["c04_anchored_600"] = on_pairs(pairs("p", "TP-CORR-WIN-0002", 600, 600), "p")
ORACLES["c04_anchored_3600"] = on_pairs(pairs("p", "T-CORR-3600", 3600, 3600), "p")
ORACLES["c04_anchored_short_window"] = on_pairs(pairs("p", "T-CORR-900", 900, 3600), "p")
ORACLES["c04_anchored_late_arrivals"] = on_pairs(
    late_pairs("p", "T-CORR-3600", 3600, "arrival_seq * 7919 % 1000003"), "p"
)
ORACLES["c05_grouping"] = on_findings(
    "SELECT source_host, event_record_id, count(*) AS findings FROM f WHERE event_record_id % 9 <> 0 GROUP BY ALL"
)
ORACLES["c06_without_copies"] = on_findings(
    f"SELECT finding_uuid, rule_id, source_host, event_record_id, min(arrival_seq) AS arrival_seq FROM {_TWICE} GROUP BY ALL"
)
_FIRSTS = """firsts AS (
  SELECT source_host, rule_id, finding_uuid, event_time, event_key FROM f
  QUALIFY row_number() OVER (PARTITION BY source_host, rule_id ORDER BY event_time, arrival_seq) = 1),
paired AS (
  SELECT a.source_host, a.finding_uuid AS a_id, b.finding_uuid AS b_id, a.event_time AS a_time, b.event_time AS b_time,
    a.event_key AS a_key, b.event_key AS b_key
  FROM firsts a JOIN firsts b USING (source_host)
  WHERE a.rule_id = 'TP-WIN-SYSMON-0001' AND b.rule_id = 'TP-WIN-SYSMON-0002')"""
ORACLES["c07_first_required"] = over(
    f"{telemetry()}, {FINDINGS}, {_FIRSTS}",
    "SELECT source_host, CAST(to_json(CASE WHEN b_time <= a_time THEN [b_id, a_id] ELSE [a_id, b_id] END) AS VARCHAR) "
    "AS finding_ids, CASE WHEN b_time <= a_time THEN '[\"TP-WIN-SYSMON-0002\",\"TP-WIN-SYSMON-0001\"]' "
    "ELSE '[\"TP-WIN-SYSMON-0001\",\"TP-WIN-SYSMON-0002\"]' END AS rule_ids FROM paired",
)
ORACLES["c08_time_span"] = over(
    f"{telemetry()}, {FINDINGS}, {_FIRSTS}",
    f"SELECT {MATCH_IDS} FROM " + keyed(
        "(SELECT 'TP-CORR-WIN-0001' AS rule_id, source_host, least(a_time, b_time) AS first_event_time, "
        "greatest(a_time, b_time) AS last_event_time, "
        "CASE WHEN a_time <= b_time THEN [a_id, b_id] ELSE [b_id, a_id] END AS ids, list_sort([a_key, b_key]) AS keys "
        "FROM paired WHERE abs(epoch_us(a_time) - epoch_us(b_time)) <= 3600000000)"
    ),
)
_MATCH_COLUMNS = """correlation_uuid, correlation_key, rule_id, rule_version, title, severity, source_host,
  first_event_time, last_event_time, CAST(to_json(ids) AS VARCHAR) AS matched_finding_ids,
  CAST(to_json(rule_ids) AS VARCHAR) AS matched_detection_rule_ids, explanation,
  CAST(to_json(investigation_steps) AS VARCHAR) AS investigation_steps, evidence,
  CAST(to_json(tags) AS VARCHAR) AS tags, created_at"""
ORACLES["c09_match_projection"] = on_chain(f"SELECT {_MATCH_COLUMNS} FROM matches")
ORACLES["c10_event_keys"] = on_findings(
    "SELECT finding_uuid, concat_ws('|', source_host, source_type, event_id, CASE WHEN event_record_id % 9 = 0 "
    "THEN 'None' ELSE CAST(event_record_id AS VARCHAR) END, rule_id, rule_version) AS event_key FROM f"
)
ORACLES["c11_correlation_key"] = on_findings(
    "SELECT finding_uuid, sha256('TP-CORR-WIN-0002|1|' || source_host || '|' || event_key) AS correlation_key FROM f"
)
ORACLES["c12_insert_new_matches"] = over(
    f"{telemetry()}, {FINDINGS}, {pairs('h', 'T-CORR-3600', 3600, None)}, {pairs('l', 'T-CORR-3600', 3600, 3600)}",
    f"SELECT correlation_uuid, correlation_key, source_host, last_event_time FROM {keyed('h')} "
    f"WHERE correlation_key NOT IN (SELECT correlation_key FROM {keyed('l')})",
)
ORACLES["c13_new_finding_required"] = on_pairs(pairs("p", "T-CORR-3600", 3600, 3600), "p") + (
    " WHERE last_event_time >= TIMESTAMP '2024-01-16 00:00:00'"
)
ORACLES["c14_look_back"] = on_findings(
    "SELECT finding_uuid, count(*) OVER (PARTITION BY source_host ORDER BY event_time RANGE BETWEEN INTERVAL 3600 "
    "SECOND PRECEDING AND CURRENT ROW) AS candidates FROM f"
)
ORACLES["c16_encoded_execution"] = on_pairs(SAME, "same")
ORACLES["c17_repeated_encoded"] = on_chain(
    "SELECT correlation_uuid, title, severity, source_host, evidence, CAST(to_json(tags) AS VARCHAR) AS tags "
    "FROM matches WHERE rule_id = 'TP-CORR-WIN-0002'"
)

# ---------------------------------------------------------------- risk and alerts

_DELTA = "(minute(last_event_time) * 4 - 120)"
_BASE = "CASE rule_id WHEN 'TP-CORR-WIN-0001' THEN 40 ELSE 65 END"
_SWUNG = f"greatest(0, least({_BASE} + {_DELTA}, 100))"


def level(score: str) -> str:
    return (
        f"CASE WHEN {score} <= 19 THEN 'informational' WHEN {score} <= 39 THEN 'low' WHEN {score} <= 59 THEN 'medium' "
        f"WHEN {score} <= 79 THEN 'high' ELSE 'critical' END"
    )


ORACLES["r01_base_score"] = on_telemetry(
    "SELECT record_id, CASE record_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 40 WHEN 3 THEN 65 ELSE 85 END "
    "AS base_score FROM tel"
)
ORACLES["r02_providers"] = on_chain(
    "SELECT correlation_uuid, CAST(i AS INTEGER) AS place, 'swing' AS provider, 'minute' AS reason, "
    f"CAST(CASE WHEN i = 0 THEN {_DELTA} ELSE 0 END AS INTEGER) AS score_delta, "
    "'{\"minute\":' || minute(last_event_time) || '}' AS evidence FROM matches, (VALUES (0), (1), (2)) places(i) "
    "UNION ALL SELECT correlation_uuid, 3, 'repeated_activity', 'Repeated encoded PowerShell activity occurred within "
    "the correlation window.', 15, '{\"correlation_rule_id\":\"TP-CORR-WIN-0002\",\"finding_count\":2}' "
    "FROM matches WHERE rule_id = 'TP-CORR-WIN-0002'"
)
ORACLES["r03_repeated_activity"] = on_chain("SELECT correlation_uuid, contributions FROM risks")
ORACLES["r04_clamped_score"] = on_chain(
    f"SELECT correlation_uuid, CAST({_SWUNG} AS INTEGER) AS score FROM matches"
)
ORACLES["r05_levels"] = on_telemetry(
    f"SELECT {level('(record_id % 260 - 80)')} AS level, count(*) AS scores FROM tel GROUP BY ALL"
)
_RISK_COLUMNS = (
    "assessment_uuid, correlation_uuid, correlation_rule_id, score, level, base_score, source_host, "
    "first_event_time, last_event_time, assessed_at, explanation, evidence, created_at"
)
ORACLES["r06_assessments"] = on_chain(f"SELECT {_RISK_COLUMNS} FROM risks")
ORACLES["r07_contribution_record"] = on_telemetry(
    "SELECT record_id, '{\"provider\":\"level\",\"reason\":\"level ' || level || '\",\"score_delta\":' || level || "
    "',\"evidence\":\"{}\"}' AS item FROM tel"
)
ORACLES["a01_threshold"] = on_chain(
    f"SELECT correlation_uuid, CAST({_SWUNG} AS INTEGER) AS risk_score FROM matches WHERE {_SWUNG} >= 70"
)
ORACLES["a02_alert_texts"] = on_chain("SELECT alert_uuid, title, summary FROM alerts")
ORACLES["a03_alerts"] = on_chain("SELECT * FROM alerts")
ORACLES["a05_chain_counts"] = on_chain(
    "SELECT (SELECT count(*) FROM matches) AS correlations_created, (SELECT count(*) FROM risks) AS "
    "assessments_created, (SELECT count(*) FROM alerts) AS alerts_created"
)
ORACLES["a06_full_chain"] = over(
    f"{telemetry()}, {FINDINGS}, {SAME}, {pairs('p', 'T-CORR-LOW', 3600, 3600)}",
    "SELECT rule_id AS correlation_rule_id, count(*) AS assessments, count(*) AS alerts FROM same GROUP BY rule_id "
    "UNION ALL SELECT rule_id, count(*), 0 FROM p GROUP BY rule_id",
)

# ---------------------------------------------------------------- telemetry queries

_LIST = (
    "SELECT event_record_id, source_host AS host, source_type, provider_name AS provider, event_id, severity, "
    f"{time_text('time_created')} AS time_created, message FROM logs"
)
_SHORT = (
    f"SELECT source_host AS host, provider_name AS provider, event_id, {time_text('time_created')} AS time_created, "
    "message FROM logs"
)
_NEW_LOGS = "ORDER BY inserted_at DESC NULLS FIRST, event_record_id DESC"
ORACLES["q01_latest_logs"] = on_logs(f"{_LIST} {_NEW_LOGS} LIMIT 100")
ORACLES["q02_logs_of_provider"] = on_logs(f"{_SHORT} WHERE provider_name ILIKE '%windows-power%' {_NEW_LOGS} LIMIT 100")
ORACLES["q03_logs_of_event"] = on_logs(f"{_SHORT} WHERE event_id = 4624 {_NEW_LOGS} LIMIT 100")
ORACLES["q04_event_counts"] = on_logs('SELECT event_id, count(*) AS "count" FROM logs GROUP BY event_id ORDER BY 2 DESC, 1')
ORACLES["q05_search_logs"] = on_logs(
    f"{_LIST} WHERE message ILIKE '%user1_ hashes%' OR provider_name ILIKE '%user1_ hashes%' "
    f"OR source_host ILIKE '%user1_ hashes%' {_NEW_LOGS} LIMIT 100"
)
ORACLES["q05b_search_escaped"] = on_logs(
    f"{_LIST} WHERE contains(lower(message), 'c:\\program files\\powershell') {_NEW_LOGS} LIMIT 100"
)
ORACLES["q06_logs_of_source"] = on_logs(
    f"{_LIST} WHERE source_type ILIKE '%windows\\_s%y%' ESCAPE '\\' {_NEW_LOGS} LIMIT 100"
)
_METRIC = (
    f"SELECT host_name AS host, cpu_percent, memory_percent, disk_percent, {time_text('boot_time')} AS boot_time, "
    f"{time_text('collected_at')} AS collected_at FROM metrics ORDER BY metrics.collected_at DESC NULLS FIRST, host_name DESC"
)
ORACLES["q07_latest_metric"] = over(METRICS, f"{_METRIC} LIMIT 1")
ORACLES["q08_metrics"] = over(METRICS, f"{_METRIC} LIMIT 100")
ORACLES["q09_detections"] = on_chain(
    f"SELECT {FINDING_COLUMNS} FROM f WHERE source_host = 'HOST-03' AND severity = 'medium' "
    "ORDER BY evaluated_at DESC NULLS FIRST, finding_uuid DESC LIMIT 25"
)
ORACLES["q10_correlations"] = on_chain(
    f"SELECT {_MATCH_COLUMNS.replace('correlation_key, ', '').replace(', created_at', '')} FROM matches "
    "WHERE source_host = 'HOST-01' AND severity = 'medium' ORDER BY created_at DESC NULLS FIRST, correlation_uuid DESC LIMIT 50"
)
ORACLES["q11_risk_assessments"] = on_chain(
    f"SELECT {_RISK_COLUMNS.replace(', created_at', '')}, contributions FROM risks WHERE level = 'critical' AND score >= 60 "
    "ORDER BY assessed_at DESC NULLS FIRST, assessment_uuid DESC LIMIT 100"
)
_ALERT = "SELECT * EXCLUDE (inserted_at) FROM alerts"
ORACLES["q12_alerts"] = on_chain(
    f"{_ALERT} WHERE source_host = 'HOST-01' AND status = 'new' AND risk_level = 'medium' AND risk_score >= 40 "
    "ORDER BY created_at DESC NULLS FIRST, alert_uuid DESC LIMIT 10"
)
ORACLES["q13_alert_by_id"] = on_chain(f"{_ALERT} WHERE alert_uuid = (SELECT min(alert_uuid) FROM alerts)")
ORACLES["q14_no_conditions"] = on_chain(
    "SELECT alert_uuid, created_at FROM alerts ORDER BY created_at DESC NULLS FIRST, alert_uuid DESC LIMIT 500"
)
ORACLES["q16_response_projection"] = over(
    METRICS,
    f"SELECT host_name AS host, cpu_percent, {time_text('boot_time')} AS boot_time, "
    f"{time_text('collected_at')} AS collected_at FROM metrics",
)

# ---------------------------------------------------------------- analyst queries

_STORED_METRICS = "SELECT host_name, cpu_percent, memory_percent, disk_percent, boot_time, collected_at FROM metrics"
_NEW_METRICS = "ORDER BY collected_at DESC NULLS FIRST, host_name DESC"
ORACLES["b01_recent_logs"] = on_logs(f"SELECT {LOG_COLUMNS} FROM logs {_NEW_LOGS} LIMIT 50")
for _name, _key in (
    ("b02_logs_by_source", "source_type"), ("b03_logs_by_provider", "provider_name"), ("b04_logs_by_event_id", "event_id"),
):
    ORACLES[_name] = on_logs(f"SELECT {_key}, count(*) AS event_count FROM logs GROUP BY {_key} ORDER BY 2 DESC, 1")
ORACLES["b05_latest_metrics"] = over(METRICS, f"{_STORED_METRICS} {_NEW_METRICS} LIMIT 20")
ORACLES["b06_high_memory"] = over(METRICS, f"{_STORED_METRICS} WHERE memory_percent > 80 {_NEW_METRICS}")
ORACLES["b07_high_disk"] = over(METRICS, f"{_STORED_METRICS} WHERE disk_percent > 80 {_NEW_METRICS}")
ORACLES["b08_recent_processes"] = on_processes(
    "SELECT source_host, image, command_line, parent_image, user_name, created_at FROM processes "
    "ORDER BY inserted_at DESC NULLS FIRST, process_guid DESC LIMIT 50"
)
ORACLES["b09_powershell_processes"] = on_processes(
    "SELECT * FROM processes WHERE image ILIKE '%powershell%' OR command_line ILIKE '%powershell%' "
    "ORDER BY created_at DESC NULLS FIRST, process_guid DESC"
)
_NEW_RUNS = "SELECT * FROM runs ORDER BY started_at DESC NULLS FIRST, source_host DESC LIMIT"
ORACLES["b10_collector_history"] = over(f"{telemetry()}, {RUNS}", f"{_NEW_RUNS} 50")
ORACLES["b28e_collector_health"] = over(f"{telemetry()}, {RUNS}", f"{_NEW_RUNS} 20")
_NEW_FINDINGS = "FROM f ORDER BY created_at DESC NULLS FIRST, finding_uuid DESC LIMIT"
_TAGS = "CAST(to_json(tags) AS VARCHAR) AS tags"
ORACLES["b11_recent_findings"] = on_chain(
    "SELECT finding_uuid, rule_id, rule_version, title, severity, source_host, source_type, event_id, event_record_id, "
    f"event_time, evaluated_at, {_TAGS} {_NEW_FINDINGS} 50"
)
ORACLES["b12_finding_counts"] = on_chain(
    "SELECT rule_id, rule_version, title, severity, count(*) AS finding_count FROM f GROUP BY ALL ORDER BY 5 DESC"
)
ORACLES["b13_recent_encoded_findings"] = on_chain(
    "SELECT finding_uuid, source_host, event_record_id, event_time, evidence FROM f WHERE rule_id = 'TP-WIN-SYSMON-0002' "
    "ORDER BY event_time DESC NULLS FIRST, finding_uuid DESC LIMIT 50"
)
_NEW_MATCHES = "FROM matches ORDER BY created_at DESC NULLS FIRST, correlation_uuid DESC LIMIT"
_IDS = "CAST(to_json(ids) AS VARCHAR) AS matched_finding_ids"
ORACLES["b14_recent_matches"] = on_chain(
    "SELECT correlation_uuid, correlation_key, rule_id, rule_version, title, severity, source_host, first_event_time, "
    f"last_event_time, {_IDS}, CAST(to_json(rule_ids) AS VARCHAR) AS matched_detection_rule_ids, {_TAGS} {_NEW_MATCHES} 50"
)
ORACLES["b15_match_counts"] = on_chain(
    "SELECT rule_id, rule_version, title, severity, count(*) AS match_count FROM matches GROUP BY ALL ORDER BY 5 DESC"
)
_NEW_RISKS = "FROM risks ORDER BY created_at DESC NULLS FIRST, assessment_uuid DESC LIMIT"
ORACLES["b16_recent_assessments"] = on_chain(
    "SELECT assessment_uuid, correlation_uuid, correlation_rule_id, score, level, base_score, source_host, assessed_at, "
    f"explanation {_NEW_RISKS} 50"
)
ORACLES["b17_highest_risk"] = on_chain(
    "SELECT assessment_uuid, correlation_uuid, correlation_rule_id, score, level, source_host, assessed_at, contributions "
    "FROM risks ORDER BY score DESC NULLS FIRST, assessed_at DESC, assessment_uuid DESC LIMIT 25"
)
ORACLES["b18_assessment_counts"] = on_chain(
    "SELECT level, count(*) AS assessment_count FROM risks GROUP BY level ORDER BY 2 DESC"
)
_NEW_ALERTS = "FROM alerts ORDER BY inserted_at DESC NULLS FIRST, alert_uuid DESC LIMIT"
ORACLES["b19_recent_alerts"] = on_chain(
    "SELECT alert_uuid, assessment_uuid, correlation_uuid, correlation_rule_id, title, risk_score, risk_level, status, "
    f"source_host, created_at {_NEW_ALERTS} 50"
)
_STATES = (
    "(SELECT * REPLACE (CASE minute(last_event_time) % 4 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'resolved' "
    "WHEN 2 THEN 'suppressed' ELSE 'new' END AS status) FROM alerts)"
)
ORACLES["b20_open_alerts"] = on_chain(
    f"SELECT alert_uuid, title, risk_score, risk_level, status, source_host, created_at, summary FROM {_STATES} "
    "WHERE status IN ('new', 'acknowledged') ORDER BY risk_score DESC NULLS FIRST, created_at DESC, alert_uuid DESC"
)
ORACLES["b21_alerts_by_status"] = on_chain(
    f"SELECT status, count(*) AS alert_count FROM {_STATES} GROUP BY status ORDER BY 2 DESC, 1"
)
ORACLES["b22_alerts_by_level"] = on_chain(
    "SELECT risk_level, count(*) AS alert_count FROM alerts GROUP BY risk_level ORDER BY 2 DESC, 1"
)
ORACLES["b23_investigation_chain"] = on_chain(
    "SELECT a.alert_uuid, a.title AS alert_title, a.status, a.risk_score, a.risk_level, a.source_host, "
    "a.created_at AS alert_created_at, r.assessment_uuid, r.base_score, r.contributions, c.correlation_uuid, "
    "c.title AS correlation_title, CAST(to_json(c.ids) AS VARCHAR) AS matched_finding_ids FROM alerts a "
    "JOIN risks r ON r.assessment_uuid = a.assessment_uuid JOIN matches c ON c.correlation_uuid = a.correlation_uuid "
    "ORDER BY a.created_at DESC NULLS FIRST, a.alert_uuid DESC LIMIT 25"
)
ORACLES["b24_activity_by_host"] = on_chain(
    "SELECT source_host, count(*) AS alert_count, max(created_at) AS latest_alert_time, max(risk_score) AS "
    "highest_risk_score FROM alerts GROUP BY source_host ORDER BY 4 DESC, 2 DESC, 1"
)
ORACLES["b25_existing_tables"] = on_chain(
    "SELECT count(*) AS alerts, 'stored_correlation_matches' AS stored_correlation_matches, "
    "CAST(NULL AS VARCHAR) AS stored_risk_assessments, 'stored_alerts' AS stored_alerts FROM alerts"
)
ORACLES["b26_latest_events"] = on_logs(
    f"SELECT {LOG_COLUMNS} FROM logs ORDER BY time_created DESC NULLS FIRST, event_record_id DESC LIMIT 50"
)
ORACLES["b27_recent_processes_by_creation"] = on_processes(
    "SELECT source_host, image, command_line, user_name, created_at FROM processes "
    "ORDER BY created_at DESC NULLS FIRST, process_guid DESC LIMIT 50"
)
ORACLES["b28a_findings_with_evidence"] = on_chain(
    "SELECT finding_uuid, rule_id, rule_version, title, severity, source_host, event_id, event_record_id, event_time, "
    f"evaluated_at, evidence, {_TAGS} {_NEW_FINDINGS} 20"
)
ORACLES["b28b_matches_with_evidence"] = on_chain(
    "SELECT correlation_uuid, rule_id, rule_version, title, severity, source_host, first_event_time, last_event_time, "
    f"{_IDS}, evidence {_NEW_MATCHES} 20"
)
ORACLES["b28c_assessments_with_evidence"] = on_chain(
    "SELECT assessment_uuid, correlation_uuid, correlation_rule_id, score, level, source_host, assessed_at, "
    f"contributions, evidence {_NEW_RISKS} 20"
)
ORACLES["b28d_recent_alerts_short"] = on_chain(
    "SELECT alert_uuid, assessment_uuid, correlation_uuid, title, risk_score, risk_level, status, source_host, "
    f"created_at {_NEW_ALERTS} 20"
)

# ---------------------------------------------------------------- data quality

_DOUBTFUL = (
    "(SELECT * REPLACE (CASE WHEN event_record_id % 5 = 0 THEN 'Severe' ELSE severity END AS severity, "
    "CASE WHEN event_record_id % 11 = 0 THEN 0 ELSE rule_version END AS rule_version, "
    "CASE WHEN event_record_id % 13 <> 0 THEN title END AS title, "
    "CASE WHEN event_record_id % 17 = 0 THEN 'copy' ELSE finding_uuid END AS finding_uuid) FROM f)"
)
_DOUBTFUL_ALERTS = (
    "(SELECT * REPLACE (CASE WHEN minute(last_event_time) % 5 = 0 THEN 101 ELSE risk_score END AS risk_score, "
    "CASE WHEN minute(last_event_time) % 7 = 0 THEN 'supercritical' ELSE risk_level END AS risk_level, "
    "CASE WHEN minute(last_event_time) % 3 = 0 THEN 'open' ELSE status END AS status) FROM alerts)"
)
ORACLES["v01_severity_domain"] = on_findings(
    f"SELECT rule_id, event_record_id, severity, '[\"severity_domain\"]' AS violations FROM {_DOUBTFUL} "
    "WHERE severity NOT IN ('informational', 'low', 'medium', 'high', 'critical')"
)
ORACLES["v02_rule_version"] = on_findings(f"SELECT rule_id, event_record_id FROM {_DOUBTFUL} WHERE rule_version > 0")
ORACLES["v03_score_range"] = on_chain(
    f"SELECT alert_uuid, risk_score FROM {_DOUBTFUL_ALERTS} WHERE risk_score NOT BETWEEN 0 AND 100"
)
ORACLES["v04_level_and_status"] = on_chain(
    "SELECT alert_uuid, CAST(to_json(list_filter([CASE WHEN risk_level = 'supercritical' THEN 'level_domain' END, "
    "CASE WHEN status = 'open' THEN 'status_domain' END], lambda x: x IS NOT NULL)) AS VARCHAR) AS violations "
    f"FROM {_DOUBTFUL_ALERTS} WHERE risk_level = 'supercritical' OR status = 'open'"
)
ORACLES["v05_required_columns"] = on_findings(
    "SELECT concat_ws(',', CASE WHEN severity = 'Severe' THEN 'severity_domain' END, "
    "CASE WHEN rule_version = 0 THEN 'rule_version_positive' END, CASE WHEN title IS NULL THEN 'title_required' END) "
    f"AS violated, count(*) AS findings FROM {_DOUBTFUL} GROUP BY ALL"
)
ORACLES["v06_repeated_ids"] = on_findings(
    f"SELECT finding_uuid, count(*) AS copies FROM {_DOUBTFUL} GROUP BY finding_uuid HAVING count(*) > 1"
)
ORACLES["v06b_unique_ids"] = on_findings(
    f"SELECT finding_uuid, rule_id, event_record_id FROM {_DOUBTFUL} "
    "QUALIFY row_number() OVER (PARTITION BY finding_uuid ORDER BY arrival_seq, rule_id) = 1"
)
ORACLES["v07_partial_uniqueness"] = on_findings(
    f"SELECT rule_id, source_host, event_record_id, count(*) AS copies FROM {_TWICE} WHERE event_record_id % 9 <> 0 "
    "GROUP BY ALL HAVING count(*) > 1"
)
ORACLES["v08_read_contract"] = on_chain("SELECT alert_uuid, risk_score, risk_level, status FROM alerts")

# ---------------------------------------------------------------- streaming and extension points

_DOCUMENT_CHAIN = f"{telemetry(from_xml=True)}, {FINDINGS}, {chain(REPEATED)}"
_THIRD = "record_id * 3 // (SELECT max(record_id) + 1 FROM tel)"
_STREAM_MATCH = "correlation_key, rule_id, source_host, first_event_time, last_event_time"
ORACLES["t01_micro_batches"] = on_documents(
    f"SELECT {_THIRD} AS batch_id, count(*) AS events FROM tel GROUP BY ALL"
)
ORACLES["t02_resumed_stream"] = over(
    _DOCUMENT_CHAIN, "SELECT finding_uuid, rule_id, source_host, event_record_id, event_time FROM f"
)
ORACLES["t03_stream_matches"] = over(_DOCUMENT_CHAIN, f"SELECT {_STREAM_MATCH} FROM matches")
_LATE = (
    "(CASE event_record_id * 3 // (SELECT max(record_id) + 1 FROM tel) WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) "
    "* 1000000000000 + event_record_id"
)
ORACLES["t04_late_files"] = over(
    f"{telemetry(from_xml=True)}, {FINDINGS}, {SAME}, {late_pairs('late', 'TP-CORR-WIN-0002', 600, _LATE)}",
    f"SELECT {_STREAM_MATCH} FROM {keyed('(SELECT rule_id, source_host, first_event_time, last_event_time, ids, keys FROM same UNION ALL SELECT * FROM late)')}",
)
ORACLES["t05_replay"] = over(
    _DOCUMENT_CHAIN,
    f"SELECT 2 * count(*) AS stored_rows, 'log_events' AS table_name FROM tel WHERE NOT {_BAD} UNION ALL "
    "SELECT count(*), 'detection_findings' FROM f UNION ALL SELECT count(*), 'correlation_matches' FROM matches "
    "UNION ALL SELECT count(*), 'risk_assessments' FROM risks UNION ALL SELECT count(*), 'alerts' FROM alerts",
)
ORACLES["u01_custom_detection_rule"] = on_telemetry(
    "SELECT 'X-0001' AS rule_id, 'critical' AS severity, record_id AS event_record_id, CAST(json_object("
    "'raw.event_data.User', user_name, 'severity', severity) AS VARCHAR) AS evidence FROM tel WHERE source_type = "
    "'powershell' AND event_id = 4104 AND (ends_with(user_name, '1') OR ends_with(user_name, '3')) "
    "AND lower(severity) IN ('error', 'warning')"
)
_TRIPLES = """
p_rows AS (
  SELECT *, count(*) OVER (PARTITION BY source_host ORDER BY event_time RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING
      AND CURRENT ROW) AS n, lag(event_time, 2) OVER w AS first_time,
    [lag(finding_uuid, 2) OVER w, lag(finding_uuid) OVER w, finding_uuid] AS ids,
    list_sort([lag(event_key, 2) OVER w, lag(event_key) OVER w, event_key]) AS keys
  FROM f WHERE rule_id = 'TP-WIN-SYSMON-0001' WINDOW w AS (PARTITION BY source_host ORDER BY event_time, arrival_seq)),
p AS (
  SELECT 'X-CORR-0001' AS rule_id, source_host, first_time AS first_event_time, event_time AS last_event_time, ids, keys
  FROM p_rows WHERE n % 3 = 0)"""
ORACLES["u02_custom_correlation_rule"] = on_pairs(_TRIPLES, "p")
_NIGHT = f"least(100, CASE rule_id WHEN 'TP-CORR-WIN-0001' THEN 40 ELSE 80 END + CASE WHEN hour(last_event_time) < 6 THEN 10 ELSE 0 END)"
ORACLES["u03_custom_provider"] = on_chain(
    f"SELECT rule_id AS correlation_rule_id, {_NIGHT} AS score, {level(_NIGHT)} AS level, count(*) AS assessments "
    "FROM matches GROUP BY ALL"
)
ORACLES["u04_custom_policies"] = on_chain(
    "SELECT 'critical' AS risk_level, 80 AS risk_score, count(*) AS alerts FROM matches "
    "WHERE rule_id = 'TP-CORR-WIN-0002' HAVING count(*) > 0"
)

ORACLES["t03b_stateful_matches"] = on_chain(f"SELECT {_STREAM_MATCH} FROM matches")

# ---------------------------------------------------------------- faulty rules, policies and parameters


def faults(source: str, key: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS fault FROM {source} WHERE {test}" for name, test in tests.items())


_TWICE = "(rule_id, rule_version) IN (SELECT (rule_id, rule_version) FROM r GROUP BY rule_id, rule_version HAVING count(*) > 1)"
ORACLES["d13_faulty_rules"] = over(
    """r AS (
  SELECT event_id AS rule_no, CASE WHEN event_id % 31 = 0 THEN '  ' ELSE 'R-' || (event_id // 2) END AS rule_id,
    (event_id // 3) % 5 AS rule_version, event_id % 13 = 0 AS severe FROM events),
c AS (SELECT event_id AS rule_no, (event_id + place) % 7 = 6 AS unknown FROM (SELECT event_id, unnest(range(1, event_id % 3 + 1)) AS place FROM events))""",
    faults("r", "rule_no", {
        "blank_id": "trim(rule_id) = ''", "version_not_positive": "rule_version <= 0", "unknown_severity": "severe",
        "no_conditions": "rule_no NOT IN (SELECT rule_no FROM c)", "unknown_operator": "rule_no IN (SELECT rule_no FROM c WHERE unknown)",
        "given_twice": _TWICE,
    }),
)
ORACLES["c15_faulty_rules"] = over(
    """r AS (
  SELECT event_id AS rule_no, CASE WHEN event_id % 31 = 0 THEN '' ELSE 'C-' || (event_id // 2) END AS rule_id,
    (event_id // 3) % 5 AS rule_version, event_id % 4 AS required, event_id % 7 AS fields, event_id % 11 AS minutes, event_id % 5 - 1 AS least,
    event_id % 6 = 0 AS sequence, event_id % 2 = 1 AS same, event_id % 13 = 0 AS severe FROM events)""",
    faults("r", "rule_no", {
        "blank_id": "rule_id = ''", "version_not_positive": "rule_version <= 0", "unknown_severity": "severe", "unknown_mode": "sequence",
        "nothing_required": "required = 0", "no_group_fields": "fields = 0", "unsupported_group_field": "fields = 1",
        "window_not_positive": "minutes = 0", "minimum_not_positive": "least <= 0",
        "minimum_below_required": "same AND least < least(required, 2)", "given_twice": _TWICE,
    }),
)
_NAME = (
    "CASE WHEN {0} % 11 = 0 THEN ' ' WHEN {0} % 7 = 1 THEN 'pair ' || ({0} // 2) ELSE 'provider ' || ({0} - ({0} % 5) // 4) END"
)
ORACLES["r08_faulty_contributions"] = over(
    f"""p AS (SELECT provider_no, {_NAME.format('provider_no')} AS name FROM (SELECT DISTINCT user_id % 100 AS provider_no FROM events)),
t AS (SELECT trim(name) AS own FROM p GROUP BY trim(name) HAVING count(*) > 1),
g AS (SELECT event_id AS no, user_id % 103 AS provider_no, CASE WHEN event_id % 17 = 0 THEN 'other' ELSE {_NAME.format('(user_id % 103)')} END AS given FROM events),
m AS (SELECT * FROM g LEFT JOIN p USING (provider_no))""",
    faults("m", "'contribution ' || no AS subject", {"unknown_provider": "name IS NULL", "foreign_name": "given <> name"})
    + " UNION ALL "
    + faults("p", "'provider ' || provider_no AS subject", {"blank_name": "trim(name) = ''", "name_twice": "trim(name) <> '' AND trim(name) IN (SELECT own FROM t)"}),
)
ORACLES["r09_faulty_policies"] = over(
    """p AS (
  SELECT event_id AS policy_no, event_id % 4 * 10 AS lo, 100 - event_id % 5 * 25 AS hi, 19 + event_id % 3 AS a, 39 - event_id % 23 AS b,
    79 + event_id % 31 AS d FROM events)""",
    faults("p", "policy_no", {"bounds_out_of_order": "lo >= hi", "limits_not_rising": "a >= b OR b >= 59 OR 59 >= d", "limits_out_of_bounds": "a < lo OR d >= hi"}),
)
ORACLES["a04_faulty_thresholds"] = faults("events", "event_id AS policy_no", {
    "not_an_integer": "event_id % 9 IN (0, 1, 4)", "out_of_range": "event_id % 9 IN (2, 3) OR (event_id % 9 > 4 AND event_id % 103 > 100)",
})
ORACLES["q15_faulty_parameters"] = over(
    """q AS (
  SELECT event_id AS request_no, event_id % 6 AS kind, event_id % 700 - 5 AS number,
    CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'new' WHEN event_id % 4 = 1 THEN 'open' ELSE 'high' END AS word,
    event_id % 10 = 0 AS missing FROM events)""",
    faults("q", "request_no", {
        "limit": "kind = 0 AND (missing OR number < 1 OR number > 500)", "minimum_score": "kind = 1 AND NOT missing AND (number < 0 OR number > 100)",
        "severity": "kind = 2 AND word <> 'high'", "risk_level": "kind = 3 AND word <> 'high'", "status": "kind = 4 AND word <> 'new'",
        "unknown_name": "kind = 5",
    }),
)
