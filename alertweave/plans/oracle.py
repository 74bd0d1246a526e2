"""Expected results as SQL over the driver tables, computed from the base columns."""

from __future__ import annotations

import json

from ..functions import fixed as K

FX = """
fx0 AS (SELECT event_id AS i, user_id AS u, ts, event_type AS et FROM events),
fx AS (
  SELECT i, u, ts, et, CAST(i AS VARCHAR) AS alert_id,
    CASE WHEN i%20=0 THEN 'splunk' WHEN i%4=0 THEN 'simulator' WHEN i%7=0 THEN 'WAZUH'
         ELSE 'wazuh' END AS siem_name,
    CASE WHEN i%11=0 THEN 'UnknownSignal' WHEN i%13=0 THEN 'EdgeMissingParams'
         WHEN et='error' THEN 'MalwareHashOnHost' WHEN et='click' THEN 'PortScanFromIp'
         WHEN et='view' THEN 'BenignNoise' WHEN et='signup' THEN 'BruteForceUser'
         WHEN et='purchase' THEN 'SuspiciousProcessOnHost' END AS alert_type,
    CASE WHEN i%19<>0 THEN CAST(i%18 AS INTEGER) END AS level,
    CASE et WHEN 'error' THEN 'Malware trojan found' WHEN 'click' THEN 'Port scan detected'
         WHEN 'view' THEN 'benign health check' WHEN 'signup' THEN 'Failed login burst'
         WHEN 'purchase' THEN 'Unusual process' END AS rule_name,
    CASE WHEN i%5<>0 THEN '10.0.'||(u%8)||'.'||(i%50) END AS src_ip,
    CASE WHEN u%3<>0 THEN 'user'||u END AS username,
    CASE WHEN u%4<>0 THEN 'u-'||u END AS user_id,
    CASE WHEN i%6<>0 THEN CASE WHEN i%9=0 THEN 'SRV-'||(u%40) ELSE 'srv-'||(u%40) END END
      AS hostname,
    CASE WHEN i%4=1 THEN 'host-'||(u%60) END AS host_id,
    CASE WHEN et='error' THEN 'hash'||(i%30) END AS file_hash
  FROM fx0),
norm AS (
  SELECT *, CAST(CASE WHEN level IS NULL THEN 50 WHEN siem_name='simulator' THEN level
      WHEN level<=0 THEN 0 WHEN level<=15 THEN round(level*100.0/15.0)
      ELSE least(level,100) END AS INTEGER) AS severity,
    CASE WHEN siem_name='splunk' THEN 'No mapper could be resolved for the provided RawAlert.'
      WHEN hostname IS NULL AND host_id IS NULL AND username IS NULL AND user_id IS NULL
        AND src_ip IS NULL
      THEN 'NormalizedAlert validation failed: At least one entity must be present (host/user/ip).'
      END AS reject_reason
  FROM fx),
v AS (SELECT * FROM norm WHERE reject_reason IS NULL)"""

DIMS = """
assets AS (SELECT s_suppkey AS pos, 'host-'||s_suppkey AS host_id, 'srv-'||(s_suppkey%40) AS hostname,
  '10.0.'||(s_suppkey%8)||'.'||(s_suppkey%50) AS ip, CAST(s_nationkey%6 AS INTEGER) AS criticality,
  CASE WHEN s_suppkey%2=0 THEN 'prod' ELSE 'dev' END AS environment,
  'owner'||s_nationkey AS owner,
  CASE WHEN s_suppkey%5<>0 THEN 'team'||(s_nationkey%3) END AS team FROM supplier),
idents AS (SELECT c_custkey AS pos, 'u-'||c_custkey AS user_id, 'user'||c_custkey AS username,
  c_mktsegment='MACHINERY' AS privileged, c_mktsegment AS department,
  c_acctbal<0 AS service FROM customer),
ti AS (SELECT p_partkey AS pos, '10.0.'||(p_partkey%8)||'.'||(p_partkey%50) AS src_ip,
  CASE WHEN p_partkey%3=0 THEN 'hash'||(p_partkey%30) END AS file_hash,
  p_size AS reputation, p_brand AS source, lower(p_type) AS tag FROM part),
am AS (SELECT v.i, min(a.pos) AS pos FROM v JOIN assets a
  ON v.host_id=a.host_id OR lower(v.hostname)=a.hostname OR v.src_ip=a.ip GROUP BY v.i),
im AS (SELECT v.i, min(d.pos) AS pos FROM v JOIN idents d
  ON v.user_id=d.user_id OR v.username=d.username GROUP BY v.i),
tm AS (SELECT v.i, min(t.pos) AS pos FROM v JOIN ti t
  ON v.src_ip=t.src_ip OR v.file_hash=t.file_hash GROUP BY v.i),
enr AS (
  SELECT v.*, a.pos AS apos, a.host_id AS asset_id, a.criticality, a.environment, a.owner, a.team,
    d.pos AS dpos, d.user_id AS ident_id, d.privileged, d.department, d.service,
    t.pos AS tpos, t.reputation, t.source, t.tag,
    coalesce(a.criticality, 0) AS crit, coalesce(d.privileged, false) AS priv
  FROM v LEFT JOIN am ON am.i=v.i LEFT JOIN assets a ON a.pos=am.pos
    LEFT JOIN im ON im.i=v.i LEFT JOIN idents d ON d.pos=im.pos
    LEFT JOIN tm ON tm.i=v.i LEFT JOIN ti t ON t.pos=tm.pos)"""

SCORE = """
sc AS (
  SELECT *,
    CAST(CASE alert_type WHEN 'PortScanFromIp' THEN 0.85 WHEN 'BruteForceUser' THEN 0.8
      WHEN 'MalwareHashOnHost' THEN 0.9 WHEN 'SuspiciousProcessOnHost' THEN 0.75
      WHEN 'EdgeMissingParams' THEN 0.7 WHEN 'BenignNoise' THEN 0.2 ELSE 0.5 END AS DOUBLE) AS conf,
    CAST(CASE alert_type WHEN 'PortScanFromIp' THEN 70 WHEN 'BruteForceUser' THEN 65
      WHEN 'MalwareHashOnHost' THEN 85 WHEN 'SuspiciousProcessOnHost' THEN 60
      WHEN 'EdgeMissingParams' THEN 55 WHEN 'BenignNoise' THEN 15 ELSE 40 END AS INTEGER) AS sev,
    CASE WHEN alert_type='BenignNoise' THEN 'Likely benign noise.'
      ELSE 'Suspicious activity detected.' END AS hypothesis,
    CASE alert_type WHEN 'PortScanFromIp' THEN 'BlockIp' WHEN 'BruteForceUser' THEN 'DisableUser'
      WHEN 'MalwareHashOnHost' THEN 'QuarantineFile'
      WHEN 'SuspiciousProcessOnHost' THEN 'KillProcess' END AS rec_type,
    CASE alert_type WHEN 'PortScanFromIp' THEN 'src_ip='||coalesce(src_ip,'10.0.0.1')
      WHEN 'BruteForceUser' THEN 'username='||coalesce(username,'user1')
      WHEN 'MalwareHashOnHost' THEN 'file_hash='||coalesce(file_hash,'hash')||'|host_id='||coalesce(host_id,'host-1')
      WHEN 'SuspiciousProcessOnHost' THEN 'host_id='||coalesce(host_id,'host-1')||'|process_name='||CASE WHEN et='purchase' AND i%2=0 THEN 'proc'||(i%6)||'.exe' ELSE 'powershell.exe' END
      END AS rec_params,
    CASE alert_type WHEN 'PortScanFromIp' THEN 'Block scanning IP.'
      WHEN 'BruteForceUser' THEN 'Disable targeted user.'
      WHEN 'MalwareHashOnHost' THEN 'Quarantine malware.'
      WHEN 'SuspiciousProcessOnHost' THEN 'Kill suspicious process.' END AS rec_why
  FROM enr),
hd AS (
  SELECT *, CASE WHEN conf<0.3 THEN 'ObserveMore'
      WHEN (crit>=4 OR priv) AND conf<CAST(0.85 AS DOUBLE) THEN 'EscalateToHuman'
      WHEN conf>=CAST(0.85 AS DOUBLE) AND sev>=70 THEN 'ContainAndCollect'
      WHEN conf>=CAST(0.6 AS DOUBLE) AND sev>=50 THEN 'Contain' ELSE 'NotifyOnly' END AS strategy,
    CAST(greatest(0, least(100, sev + crit*10 + CAST(trunc(conf*20) AS INTEGER))) AS INTEGER)
      AS priority
  FROM sc)"""

CANDIDATES = """
cand AS (
  SELECT i, 0 AS ord, 'Notify' AS type, '' AS params,
    CASE WHEN strategy='NotifyOnly' THEN 'Notify analysts.' ELSE 'Escalate to human analyst.' END AS rationale
    FROM hd WHERE strategy IN ('NotifyOnly','EscalateToHuman')
  UNION ALL SELECT i, 1, 'BlockIp', 'src_ip='||src_ip, 'Block suspicious source IP.' FROM hd
    WHERE strategy IN ('Contain','ContainAndCollect') AND src_ip IS NOT NULL
  UNION ALL SELECT i, 2, 'DisableUser',
    concat_ws('|', 'user_id='||user_id, 'username='||username), 'Disable user account.' FROM hd
    WHERE strategy IN ('Contain','ContainAndCollect') AND (username IS NOT NULL OR user_id IS NOT NULL)
  UNION ALL SELECT i, 3, 'IsolateHost',
    concat_ws('|', 'host_id='||host_id, 'hostname='||hostname), 'Isolate host.' FROM hd
    WHERE strategy IN ('Contain','ContainAndCollect') AND (hostname IS NOT NULL OR host_id IS NOT NULL)
  UNION ALL SELECT i, 4, 'CollectForensics', '', 'Collect forensic artifacts.' FROM hd
    WHERE strategy='ContainAndCollect'
  UNION ALL SELECT i, 5, 'OpenTicket', '', 'Create a tracking ticket.' FROM hd
  UNION ALL SELECT i, 6, rec_type, rec_params, rec_why FROM hd WHERE rec_type IS NOT NULL
    AND (rec_type<>'BlockIp' OR src_ip IS NOT NULL)
    AND (rec_type<>'DisableUser' OR username IS NOT NULL OR user_id IS NOT NULL)),
cat AS (SELECT * FROM (VALUES
  ('BlockIp',true,true,55,30,0),('UnblockIp',false,false,10,5,1),('IsolateHost',true,true,70,60,2),
  ('UnisolateHost',false,false,15,10,3),('DisableUser',true,true,65,50,4),
  ('EnableUser',false,false,15,10,5),('KillProcess',false,true,85,85,6),
  ('QuarantineFile',false,true,85,85,7),('OpenTicket',false,false,5,5,8),
  ('Notify',false,false,5,5,9),('CollectForensics',false,true,35,20,10))
  AS t(type, undo, approval, drisk, dimpact, ordinal))"""

ACTIONS = """
dd AS (SELECT i, type, params, arg_min(rationale, ord) AS rationale FROM cand GROUP BY i, type, params),
ac0 AS (
  SELECT d.i, h.alert_id, d.type, d.params, d.rationale, c.undo, c.approval, c.ordinal,
    substr(sha256(d.type||':'||d.params),1,16) AS action_id,
    CAST(greatest(0,least(100, c.drisk + CAST(trunc((CAST(1.0 AS DOUBLE)-h.conf)*30) AS INTEGER)
      + CASE WHEN h.priv THEN 10 ELSE 0 END)) AS INTEGER) AS risk,
    CAST(greatest(0,least(100, c.dimpact + h.crit*5 + CASE WHEN h.priv THEN 10 ELSE 0 END)) AS INTEGER) AS impact
  FROM dd d JOIN hd h ON h.i=d.i JOIN cat c ON c.type=d.type),
ac AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY risk, impact, ordinal, action_id) - 1 AS INTEGER) AS seq,
  CAST(count(*) OVER (PARTITION BY i) AS INTEGER) AS n FROM ac0),
rb AS (SELECT a.i, a.alert_id, CAST(row_number() OVER (PARTITION BY a.i ORDER BY a.seq DESC) - 1 AS INTEGER) AS seq,
    substr(sha256(c.type||':'||a.params),1,16) AS action_id, c.type, CAST(c.drisk AS INTEGER) AS risk,
    CAST(c.dimpact AS INTEGER) AS impact, c.undo AS reversible, a.params,
    'Rollback for '||a.type AS rationale
  FROM ac a JOIN cat c ON c.type = CASE a.type WHEN 'BlockIp' THEN 'UnblockIp'
    WHEN 'IsolateHost' THEN 'UnisolateHost' WHEN 'DisableUser' THEN 'EnableUser' END)"""


def _decisions(name: str, env: str, min_conf: str, min_text: str, risk: int, impact: int, cap: int,
               critical: int, prod: str, priv_appr: str, crit_appr: str, priv_forbid: str,
               crit_forbid: str, env_forbid: str, approval: str = "a.approval") -> str:
    """Policy decisions with the given settings; lists are SQL value lists."""
    none = "('-')"
    return f"""
{name}0 AS (SELECT a.*, h.conf, h.sev, h.crit, h.priv, h.ts,
  list_filter([
    CASE WHEN a.type IN {env_forbid or none} THEN 'Action '''||a.type||''' is forbidden in environment ''{env}''.' END,
    CASE WHEN h.conf < {min_conf} AND a.type NOT IN ('OpenTicket','Notify') THEN 'Confidence '||printf('%.2f',h.conf)||' below minimum {min_text} for autonomous action '''||a.type||'''.' END,
    CASE WHEN h.priv AND a.type IN {priv_forbid or none} THEN 'Action '''||a.type||''' is forbidden on privileged identities.' END,
    CASE WHEN h.crit>={critical} AND a.type IN {crit_forbid or none} THEN 'Action '''||a.type||''' is forbidden on critical assets (criticality='||h.crit||').' END
  ], lambda x: x IS NOT NULL) AS den,
  list_filter([
    CASE WHEN {approval} THEN 'Catalog marks this action as approval-required by default.' END,
    CASE WHEN a.risk>={risk} THEN 'Risk '||a.risk||' exceeds approval threshold {risk}.' END,
    CASE WHEN a.impact>={impact} THEN 'Impact '||a.impact||' exceeds approval threshold {impact}.' END,
    CASE WHEN a.type IN {prod or none} THEN 'Action '''||a.type||''' requires approval in prod.' END,
    CASE WHEN h.priv AND a.type IN {priv_appr or none} THEN 'Target identity is privileged.' END,
    CASE WHEN h.crit>={critical} AND a.type IN {crit_appr or none} THEN 'Target asset is critical (criticality='||h.crit||').' END
  ], lambda x: x IS NOT NULL) AS app
  FROM ac a JOIN hd h ON h.i=a.i),
{name} AS (SELECT *, CASE WHEN n>{cap} THEN 'Denied' WHEN len(den)>0 THEN 'Denied'
    WHEN len(app)>0 THEN 'PendingApproval' ELSE 'Approved' END AS status,
  CASE WHEN n>{cap} THEN 'Plan exceeds max actions {cap}.' WHEN len(den)>0 THEN array_to_string(den,'|')
    WHEN len(app)>0 THEN array_to_string(app,'|') ELSE 'Within policy limits.' END AS reasons
  FROM {name}0)"""


POLICY = _decisions(
    "po", "dev", "CAST(CAST(0.6 AS FLOAT) AS DOUBLE)", "0.60", 70, 70, 6, 4, "", "('DisableUser')",
    "('IsolateHost','DisableUser')", "('DisableUser')", "('KillProcess','QuarantineFile')", "",
)
STRICT = _decisions(
    "ps", "prod", "CAST(CAST(0.75 AS FLOAT) AS DOUBLE)", "0.75", 60, 60, 4, 3,
    "('DisableUser','IsolateHost','QuarantineFile','KillProcess','CollectForensics')",
    "('DisableUser','IsolateHost')", "('IsolateHost','DisableUser','BlockIp')",
    "('KillProcess','QuarantineFile')", "('KillProcess','QuarantineFile')",
    "('KillProcess','QuarantineFile')",
)
OPEN = _decisions(
    "pq", "dev", "CAST(CAST(0.6 AS FLOAT) AS DOUBLE)", "0.60", 101, 101, 6, 99, "", "",
    "('IsolateHost','DisableUser')", "", "('KillProcess','QuarantineFile')", "", "false",
)

RUN = """
xe AS (SELECT * FROM (VALUES
  ('BlockIp','FirewallExecutor','FW-','IP blocked (stub).'),('UnblockIp','FirewallExecutor','FW-','IP unblocked (stub).'),
  ('DisableUser','UserAccessExecutor','USER-','User disabled (stub).'),('EnableUser','UserAccessExecutor','USER-','User enabled (stub).'),
  ('IsolateHost','HostIsolationExecutor','HOST-','Host isolated (stub).'),('UnisolateHost','HostIsolationExecutor','HOST-','Host unisolate (stub).'),
  ('OpenTicket','TicketingExecutor','TICKET-','Ticket created (stub).'),('Notify','NotificationExecutor','NOTIFY-','Notification sent (stub).'))
  AS t(type, executor, prefix, done))"""

DRY = """
dry AS (SELECT p.i, p.alert_id, p.seq, p.action_id, p.type,
  CASE WHEN p.status<>'Approved' THEN 'Skipped' WHEN x.type IS NULL THEN 'Failed' ELSE 'DryRun' END AS status,
  CASE WHEN p.status<>'Approved' OR x.type IS NULL THEN 'ExecutionPipeline' ELSE x.executor END AS executor,
  CASE WHEN p.status='PendingApproval' THEN 'Policy pending approval.'
    WHEN p.status='Denied' THEN 'Denied by policy.' WHEN x.type IS NULL THEN 'No executor registered.'
    ELSE 'Dry-run: execution skipped.' END AS message
  FROM po p LEFT JOIN xe x ON x.type=p.type)"""

STOP = """
st0 AS (SELECT p.*, x.executor AS xname, x.prefix, x.done,
  (p.type='IsolateHost' AND p.i%5<3) OR (p.type='Notify' AND p.i%7=0) AS refused
  FROM pq p LEFT JOIN xe x ON x.type=p.type),
st1 AS (SELECT *, CASE WHEN status<>'Approved' THEN 'Skipped' WHEN xname IS NULL THEN 'Failed'
    WHEN refused THEN 'Failed' ELSE 'Succeeded' END AS rstatus FROM st0),
stf AS (SELECT i, min(seq) FILTER (WHERE rstatus='Failed') AS f FROM st1 GROUP BY i),
st AS (SELECT s.*, stf.f,
  CASE WHEN s.status<>'Approved' OR xname IS NULL THEN 'ExecutionPipeline' ELSE xname END AS executor,
  CASE WHEN s.status='PendingApproval' THEN 'Policy pending approval.'
    WHEN s.status='Denied' THEN 'Denied by policy.' WHEN xname IS NULL THEN 'No executor registered.'
    WHEN refused THEN 'refused' ELSE done END AS message,
  CASE WHEN rstatus='Succeeded' THEN prefix||action_id END AS reference
  FROM st1 s JOIN stf ON stf.i=s.i WHERE stf.f IS NULL OR s.seq<=stf.f),
stopped AS (SELECT DISTINCT i FROM st WHERE seq=f AND xname IS NOT NULL)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


V = _with(FX)
E = _with(FX, DIMS)
S = _with(FX, DIMS, SCORE)
P = _with(FX, DIMS, SCORE, CANDIDATES, ACTIONS)
D = _with(FX, DIMS, SCORE, CANDIDATES, ACTIONS, POLICY)
X = _with(FX, DIMS, SCORE, CANDIDATES, ACTIONS, POLICY, RUN, DRY)
O = _with(FX, DIMS, SCORE, CANDIDATES, ACTIONS, OPEN)  # noqa: E741
R = _with(FX, DIMS, SCORE, CANDIDATES, ACTIONS, OPEN, RUN, STOP)

PENDING = """,
pend AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY ts, i, seq) AS rn FROM po
  WHERE status='PendingApproval'),
req AS (SELECT * FROM pend WHERE rn=1),
dec AS (SELECT action_id, arg_min(i%3=0, (ts, i)) AS approve FROM pend WHERE i%3<>2 GROUP BY action_id),
state AS (SELECT r.action_id, r.type, CASE WHEN d.approve THEN 'Approved' WHEN NOT d.approve THEN 'Denied'
  ELSE 'Pending' END AS status FROM req r LEFT JOIN dec d ON d.action_id=r.action_id)"""

CASES = """WITH ce AS (SELECT 'case-'||user_id AS case_id, ts, event_id AS seq, event_type AS et,
    CASE WHEN event_type IN ('signup','click') THEN 'open' WHEN event_type='view' THEN 'evidence' ELSE 'close' END AS kind
  FROM events WHERE event_type<>'purchase'),
f AS (SELECT case_id, min((ts, seq)) AS first FROM ce WHERE kind='open' GROUP BY case_id),
live AS (SELECT ce.*, f.first FROM ce JOIN f ON f.case_id=ce.case_id WHERE (ce.ts, ce.seq) >= f.first)"""

LOGS = """WITH lg AS (SELECT event_id AS i, user_id AS u, ts, CAST(event_id AS VARCHAR) AS id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE event_type WHEN 'error' THEN 'Malware trojan found' WHEN 'click' THEN 'Port scan detected'
    WHEN 'view' THEN 'benign health check' WHEN 'signup' THEN 'Failed login burst'
    WHEN 'purchase' THEN 'Unusual process' END AS descr,
  CASE event_type WHEN 'error' THEN 'sudo: user=root COMMAND=/bin/sh' WHEN 'click' THEN 'powershell -File a.ps1'
    WHEN 'view' THEN 'authentication success' WHEN 'signup' THEN 'sshd: Accepted publickey'
    WHEN 'purchase' THEN 'Installation completed' END || CASE WHEN event_id%9=0 THEN ' self-signed' ELSE '' END AS full_log,
  event_id%17=0 AS plain,
  CASE WHEN user_id%30<>7 THEN 'a'||(user_id%30) END AS aid,
  CASE WHEN user_id%2=0 THEN 'node'||(user_id%30) END AS aname,
  CASE WHEN event_id%23<>0 THEN '10.1.0.'||(event_id%4) END AS aip
  FROM events),
usable AS (SELECT *, coalesce(aid, aname) AS agent_key FROM lg
  WHERE NOT plain AND coalesce(aid, aname) IS NOT NULL AND aip IS NOT NULL),
chg AS (SELECT * FROM (SELECT *, lag(aip) OVER (PARTITION BY agent_key ORDER BY ts, i) AS previous_ip FROM usable)
  WHERE previous_ip IS NOT NULL AND previous_ip<>aip),
hit AS (
  SELECT i, 1 AS no FROM lg WHERE contains(lower(full_log),'powershell') OR contains(lower(full_log),'.ps1')
  UNION ALL SELECT i, 3 FROM lg WHERE contains(lower(full_log),'user=root') OR contains(lower(full_log),'sudo')
  UNION ALL SELECT i, 4 FROM lg WHERE contains(lower(full_log),'sshd')
  UNION ALL SELECT i, 6 FROM lg WHERE contains(lower(full_log),'installation completed') AND NOT contains(full_log,'signed')
  UNION ALL SELECT i, 8 FROM lg WHERE contains(full_log,'self-signed')
  UNION ALL SELECT i, 9 FROM chg),
hn AS (SELECT lg.*, CAST(no AS INTEGER) AS no, h.name, h.severity, h.goal, h.completion FROM hit JOIN lg ON lg.i=hit.i
  JOIN (VALUES %s) AS h(no2, name, severity, goal, completion) ON h.no2=hit.no)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _object(**parts: str) -> str:
    """JSON object of SQL expressions that give JSON; members that are null are left out."""
    members = ", ".join(f"'\"{name}\":'||({value})" for name, value in parts.items())
    return f"('{{'||concat_ws(',', {members})||'}}')"


def _logs() -> str:
    from ..functions.fixed import HEURISTICS

    rows = ", ".join(
        f"({i}, {_quote(h['name'])}, {_quote(h['severity'])}, {_quote(h['goal'])}, "
        f"{_quote(h['completion'])})"
        for i, h in enumerate(HEURISTICS)
    )
    return LOGS.replace("(VALUES %s)", f"(VALUES {rows})")


def _response_case() -> str:
    from ..functions.fixed import RESPONSE_ACTIONS

    whens = " ".join(
        f"WHEN {_quote(k)} THEN {_quote('|'.join(v))}" for k, v in RESPONSE_ACTIONS.items()
    )
    return f"CASE severity {whens} END"


def _text_score(severity: str, rule: str = "coalesce(rule_name,'')||' '||coalesce(alert_type,'')") -> dict:
    t = f"lower({rule})"
    mal = f"(contains({t},'ransomware') OR contains({t},'trojan') OR contains({t},'malware'))"
    brute = f"(contains({t},'brute force') OR contains({t},'bruteforce') OR contains({t},'failed login'))"
    scan = f"contains({t},'scan')"
    benign = f"contains({t},'benign')"

    def pick(a, b, c, d, e):
        return f"CASE WHEN {mal} THEN {a} WHEN {brute} THEN {b} WHEN {scan} THEN {c} WHEN {benign} THEN {d} ELSE {e} END"

    return {
        "confidence": f"CAST({pick(0.85, 0.7, 0.65, 0.2, 0.5)} AS DOUBLE)",
        "severity": f"CAST({pick(85, 60, 55, 20, f'least(100,greatest(0,{severity}))')} AS INTEGER)",
        "hypothesis": pick("'Likely malware activity.'", "'Possible brute-force attempts.'",
                           "'Possible scanning activity.'", "'Likely benign noise.'",
                           "'Severity-based assessment.'"),
        "evidence": pick("'keyword:malware'", "'keyword:bruteforce'", "'keyword:scan'",
                         "'keyword:benign'", "'source:severity'"),
    }


# Whitespace a strip removes and line ends a line split uses, for the regex engine here.
_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def oracle_sql() -> dict[str, str]:
    ts = _text_score("severity")
    td = _text_score("severity", "coalesce(rule_name,'')||' '")
    q: dict[str, str] = {}
    q["normalize_alerts"] = V + """
SELECT alert_id, siem_name, epoch_us(ts) AS ts_us, alert_type, rule_name, severity, hostname, host_id,
  username, user_id, src_ip, CASE WHEN i%5<>0 AND i%3=1 THEN '192.168.0.'||(i%9) END AS dst_ip,
  CASE WHEN i%7=2 THEN 'd'||(u%5)||'.example' END AS domain,
  CASE WHEN et='purchase' AND i%2=0 THEN 'proc'||(i%6)||'.exe' END AS process_name,
  CASE WHEN et='purchase' THEN '/bin/proc'||(i%6) END AS process_path, file_hash FROM v"""
    q["reject_alerts"] = V + """
SELECT alert_id, siem_name, reject_reason FROM norm WHERE reject_reason IS NOT NULL"""
    q["unwrap_responses"] = V + """
SELECT * FROM (
 SELECT alert_id, 'wazuh' AS siem_name,
   CASE WHEN i%10=0 THEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') ELSE epoch_us(ts) END AS ts_us,
   rule_name, CAST(i%90 AS VARCHAR) AS alert_type, level AS original_severity,
   CASE WHEN i%6 IN (0,2) THEN CAST(i+1 AS VARCHAR) WHEN i%6=1 THEN 'n'||i END AS next_cursor FROM fx
 UNION ALL
 SELECT alert_id||'b', 'wazuh', epoch_us(ts), rule_name, alert_type, NULL,
   CASE WHEN i%6 IN (0,2) THEN CAST(i+1 AS VARCHAR) WHEN i%6=1 THEN 'n'||i END FROM fx WHERE i%6<>5)"""
    q["push_headers"] = V + """
SELECT alert_id AS source_id, CASE WHEN siem_name='splunk' THEN 'wazuh' ELSE siem_name END AS siem_name,
  CASE WHEN siem_name<>'simulator' THEN rule_name END AS rule_name, CAST(NULL AS VARCHAR) AS alert_type,
  CASE WHEN siem_name<>'simulator' THEN level END AS original_severity FROM fx"""
    q["page_alerts"] = """
SELECT CAST(event_id AS VARCHAR) AS alert_id, rn AS position, rn//200 AS page,
  CASE WHEN (rn//200+1)*200 < n THEN CAST((rn//200+1)*200 AS VARCHAR) END AS next_cursor
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id)-1 AS rn, count(*) OVER () AS n FROM events)"""
    q["enrich_asset"] = E + """
SELECT alert_id, asset_id, criticality, environment,
  CASE WHEN apos IS NOT NULL THEN concat_ws('|', owner, team) END AS roles,
  CASE WHEN apos IS NOT NULL THEN 'asset_owner='||owner||'|asset_team='||coalesce(team,'') END AS tags,
  CASE WHEN apos IS NOT NULL THEN 'Asset matched.' END AS note FROM enr"""
    q["enrich_identity"] = E + """
SELECT alert_id, ident_id AS user_id, privileged, department,
  CASE WHEN service THEN 'service_account' END AS groups,
  CASE WHEN dpos IS NOT NULL THEN 'department='||department||'|is_service_account='||
    CASE WHEN service THEN 'True' ELSE 'False' END END AS tags FROM enr"""
    q["enrich_intel"] = E + """
SELECT alert_id, reputation, tag AS matches,
  CASE WHEN tpos IS NOT NULL THEN 'ti_source='||source END AS tags FROM enr"""
    q["enrich_merged"] = E + """
SELECT alert_id, asset_id, ident_id AS user_id, reputation, concat_ws('|',
    CASE WHEN apos IS NOT NULL THEN 'asset_owner='||owner||'|asset_team='||coalesce(team,'') END,
    CASE WHEN dpos IS NOT NULL THEN 'department='||department||'|is_service_account='||
      CASE WHEN service THEN 'True' ELSE 'False' END END,
    CASE WHEN tpos IS NOT NULL THEN 'ti_source='||source END) AS tags,
  concat_ws('|', CASE WHEN apos IS NOT NULL THEN 'AssetInventory' END,
    CASE WHEN dpos IS NOT NULL THEN 'Identity' END,
    CASE WHEN tpos IS NOT NULL THEN 'ThreatIntel' END) AS providers FROM enr"""
    q["score_scenario"] = S + """
SELECT alert_id, alert_type AS scenario, conf AS confidence, sev AS severity, hypothesis,
  'scenario:'||alert_type AS evidence, rec_type AS action, rec_params AS params, rec_why AS rationale FROM sc"""
    q["score_rules"] = V + f"""
SELECT alert_id, {ts['confidence']} AS confidence, {ts['severity']} AS severity,
  {ts['hypothesis']} AS hypothesis, {ts['evidence']} AS evidence FROM v"""
    q["score_fallback"] = V + f"""
SELECT alert_id,
  CASE WHEN i%3=0 THEN CAST(0.95 AS DOUBLE) WHEN i%5=0 THEN CAST(0.2 AS DOUBLE) ELSE {ts['confidence']} END AS confidence,
  CAST(CASE WHEN i%3=0 THEN i%100 WHEN i%5=0 THEN 10 ELSE {ts['severity']} END AS INTEGER) AS severity,
  CASE WHEN i%3=0 THEN 'model' WHEN i%5=0 THEN 'Scoring failed: TimeoutError' ELSE {ts['hypothesis']} END AS hypothesis,
  CASE WHEN i%3=0 THEN 'm' WHEN i%5=0 THEN 'too slow' ELSE {ts['evidence']} END AS evidence FROM v"""
    q["score_distinct"] = V + f"""
SELECT alert_id, {td['confidence']} AS confidence, {td['severity']} AS severity,
  {td['hypothesis']} AS hypothesis FROM v"""
    q["explanations"] = V + """
SELECT alert_id, 'Stub explanation for '||alert_type||'.' AS summary,
  'Deterministic stub scorer.|scenario='||alert_type AS details FROM v"""
    summary = "'Strategy='||strategy||', Severity='||sev||', Confidence='||printf('%.2f',conf)"
    q["plan_header"] = S + f"""
SELECT alert_id, siem_name, alert_type, severity, conf AS confidence, strategy, priority,
  {summary} AS summary FROM hd"""
    rank = """CASE type WHEN 'Notify' THEN 0 WHEN 'OpenTicket' THEN 1 WHEN 'BlockIp' THEN 2
      WHEN 'DisableUser' THEN 3 WHEN 'IsolateHost' THEN 4 WHEN 'CollectForensics' THEN 5 ELSE 6 END"""
    q["plan_selection"] = _with(FX, DIMS, SCORE, CANDIDATES) + f"""
SELECT CAST(i AS VARCHAR) AS alert_id, string_agg(type, '|' ORDER BY {rank}, ord) AS types,
  string_agg(rationale, '|' ORDER BY {rank}, ord) AS rationales FROM cand GROUP BY i"""
    q["plan_actions"] = P + """
SELECT alert_id, seq, action_id, type, risk, impact, undo AS reversible, params, rationale FROM ac"""
    q["plan_catalog_gaps"] = P + """,
gap AS (SELECT *, type='IsolateHost' AS strange FROM ac0 WHERE type<>'OpenTicket'),
gp AS (SELECT alert_id, i, action_id, type, params, rationale, ordinal, CAST(CASE WHEN strange THEN 100 ELSE risk END AS INTEGER) AS risk,
  CAST(CASE WHEN strange THEN 100 ELSE impact END AS INTEGER) AS impact, undo AND NOT strange AS reversible FROM gap)
SELECT alert_id, CAST(row_number() OVER (PARTITION BY i ORDER BY risk, impact, ordinal, action_id) - 1 AS INTEGER) AS seq,
  action_id, type, risk, impact, reversible, params, rationale FROM gp"""
    q["plan_rollbacks"] = P + """
SELECT alert_id, seq, action_id, type, risk, impact, reversible, params, rationale FROM rb"""
    q["plan_texts"] = S + """
SELECT alert_id, substr(sha256(siem_name||':'||alert_id),1,32) AS plan_id,
  'Selected strategy '||strategy||' based on confidence '||printf('%.2f',conf)||' and severity '||sev||'.|'||
  'Asset criticality: '||crit||'; privileged identity: '||CASE WHEN priv THEN 'True' ELSE 'False' END||'.|'||
  'Environment: dev; DryRun: True.|Hypothesis: '||hypothesis||'|Evidence count: 1' AS rationale,
  'alert_id='||alert_id||'|confidence='||printf('%.2f',conf)||'|environment=dev|severity='||sev||'|siem='||siem_name AS tags
FROM hd"""
    q["plan_static"] = S + """,
sp AS (
  SELECT alert_id, 0 AS o, 'Notify' AS type, 5 AS risk, 5 AS impact, '' AS params,
    CASE WHEN strategy='NotifyOnly' THEN 'Notify analysts.' ELSE 'Escalate to human analyst.' END AS rationale
    FROM hd WHERE strategy IN ('NotifyOnly','EscalateToHuman')
  UNION ALL SELECT alert_id, 1, 'BlockIp', 55, 30, 'src_ip='||src_ip, 'Block suspicious source IP.' FROM hd
    WHERE strategy IN ('Contain','ContainAndCollect') AND src_ip IS NOT NULL
  UNION ALL SELECT alert_id, 2, 'DisableUser', 65, 50, 'username='||username, 'Disable user account.' FROM hd
    WHERE strategy IN ('Contain','ContainAndCollect') AND username IS NOT NULL
  UNION ALL SELECT alert_id, 3, 'IsolateHost', 70, 60, 'host_id='||coalesce(host_id,hostname), 'Isolate host.' FROM hd
    WHERE strategy IN ('Contain','ContainAndCollect') AND coalesce(host_id,hostname) IS NOT NULL
  UNION ALL SELECT alert_id, 4, 'CollectForensics', 35, 20, '', 'Collect forensic artifacts.' FROM hd WHERE strategy='ContainAndCollect'
  UNION ALL SELECT alert_id, 5, 'OpenTicket', 5, 5, '', 'Create a tracking ticket.' FROM hd),
un AS (SELECT alert_id, 100-o AS o, CASE type WHEN 'BlockIp' THEN 'UnblockIp' WHEN 'DisableUser' THEN 'EnableUser' ELSE 'UnisolateHost' END AS type,
  CASE type WHEN 'BlockIp' THEN 10 ELSE 15 END AS risk, CASE type WHEN 'BlockIp' THEN 5 ELSE 10 END AS impact, params,
  'Rollback for '||type AS rationale FROM sp WHERE type IN ('BlockIp','DisableUser','IsolateHost')),
al AS (SELECT *, false AS is_rollback FROM sp UNION ALL SELECT *, true FROM un)
SELECT alert_id, CAST(row_number() OVER (PARTITION BY alert_id ORDER BY o)-1 AS INTEGER) AS seq, is_rollback, type,
  CAST(risk AS INTEGER) AS risk, CAST(impact AS INTEGER) AS impact, params, rationale FROM al"""
    q["plan_replies"] = P + """,
agg AS (SELECT i, string_agg(type,'|' ORDER BY seq) AS types, string_agg(action_id,'|' ORDER BY seq) AS action_ids,
  string_agg(CAST(risk AS VARCHAR),'|' ORDER BY seq) AS risks FROM ac GROUP BY i)
SELECT h.alert_id, CASE WHEN h.i%6 IN (0,1) THEN 'external' ELSE 'computed' END AS plan_source,
  CASE WHEN h.i%6 IN (0,1) THEN 'Contain' ELSE strategy END AS strategy,
  CAST(CASE WHEN h.i%6 IN (0,1) THEN h.i%90 ELSE priority END AS INTEGER) AS priority,
  CASE WHEN h.i%6 IN (0,1) THEN 'BlockIp|Notify' ELSE types END AS types,
  CASE WHEN h.i%6 IN (0,1) THEN substr(sha256('BlockIp:src_ip=9.9.9.'||(h.i%250)),1,16)||'|x'||h.i ELSE action_ids END AS action_ids,
  CASE WHEN h.i%6 IN (0,1) THEN '12|0' ELSE risks END AS risks
FROM hd h JOIN agg ON agg.i=h.i"""
    q["policy_actions"] = D + " SELECT alert_id, seq, type, status, reasons FROM po"
    q["policy_strict"] = _with(FX, DIMS, SCORE, CANDIDATES, ACTIONS, STRICT) + (
        " SELECT alert_id, seq, type, status, reasons FROM ps"
    )
    counts = """CAST(count(*) FILTER (WHERE status='Approved') AS INTEGER) AS approved,
  CAST(count(*) FILTER (WHERE status='PendingApproval') AS INTEGER) AS pending,
  CAST(count(*) FILTER (WHERE status='Denied') AS INTEGER) AS denied"""
    q["policy_counts"] = D + f""",
pc AS (SELECT alert_id, any_value(sev) AS sev, any_value(conf) AS conf, any_value(n) AS n, {counts} FROM po GROUP BY alert_id)
SELECT alert_id, approved, pending, denied,
  CASE WHEN n>6 THEN 'Denied: plan has '||n||' actions, exceeds limit 6.' ELSE
    'Approved='||approved||', Pending='||pending||', Denied='||denied||'.' END ||
  '|Assessment: Severity='||sev||', Confidence='||printf('%.2f',conf)||'.' AS notes FROM pc"""
    q["approval_requests"] = D + PENDING + """
SELECT action_id, alert_id, type, risk, impact, params, 'Policy approval required.' AS reason,
  'Pending' AS status, epoch_us(ts) AS requested_us FROM req"""
    q["approval_state"] = D + PENDING + " SELECT action_id, type, status FROM state"
    q["approved_actions"] = D + PENDING + """
SELECT alert_id, seq, action_id, type FROM pend WHERE action_id IN (SELECT action_id FROM state WHERE status='Approved')"""
    q["execute_dry_run"] = X + """
SELECT alert_id, seq, action_id, type, status, executor, message, CAST(NULL AS VARCHAR) AS reference,
  false AS is_rollback, CAST(NULL AS VARCHAR) AS original_action_id FROM dry"""
    q["execute_stop"] = R + """
SELECT alert_id, seq, action_id, type, rstatus AS status, executor, message, reference FROM st"""
    q["rollback_results"] = R + """,
ok AS (SELECT st.* FROM st JOIN stopped USING (i) WHERE rstatus='Succeeded'),
und AS (SELECT ok.*, CASE type WHEN 'BlockIp' THEN 'UnblockIp' WHEN 'DisableUser' THEN 'EnableUser'
    WHEN 'IsolateHost' THEN 'UnisolateHost' END AS ut,
  CAST(row_number() OVER (PARTITION BY i ORDER BY seq DESC)-1 AS INTEGER) AS rseq FROM ok)
SELECT u.alert_id, 'Stopped on first failure.' AS notes, rseq AS seq,
  CASE WHEN ut IS NULL THEN u.action_id ELSE substr(sha256(ut||':'||params),1,16) END AS action_id,
  coalesce(ut, u.type) AS type, CASE WHEN ut IS NULL THEN 'Skipped' ELSE 'Succeeded' END AS status,
  CASE WHEN ut IS NULL THEN 'ExecutionPipeline' ELSE x.executor END AS executor,
  CASE WHEN ut IS NULL THEN 'No rollback action found.' ELSE x.done END AS message,
  CASE WHEN ut IS NOT NULL THEN x.prefix||substr(sha256(ut||':'||params),1,16) END AS reference,
  u.action_id AS original_action_id
FROM und u LEFT JOIN xe x ON x.type=u.ut"""
    q["execution_counts"] = R + """
SELECT alert_id, CAST(count(*) AS INTEGER) AS total,
  CAST(count(*) FILTER (WHERE rstatus='Succeeded') AS INTEGER) AS succeeded,
  CAST(count(*) FILTER (WHERE rstatus='Failed') AS INTEGER) AS failed,
  CAST(count(*) FILTER (WHERE rstatus='Skipped') AS INTEGER) AS skipped,
  CAST(0 AS INTEGER) AS dry_run FROM st GROUP BY alert_id"""
    q["outbox"] = O + """
SELECT alert_id, action_id, type,
  CASE type WHEN 'BlockIp' THEN 'firewall' WHEN 'OpenTicket' THEN 'ticketing' ELSE 'notification' END AS target,
  CASE type WHEN 'BlockIp' THEN 'block-ip' END AS endpoint,
  CASE type WHEN 'BlockIp' THEN '{"correlationId":"'||action_id||'","ip":"'||substr(params,8)||'","reason":"'||rationale||'","ttlSeconds":3600}'
    WHEN 'OpenTicket' THEN '{"correlationId":"'||action_id||'","title":"Security ticket: OpenTicket","description":"'||rationale||'","parameters":{},"rationale":"'||rationale||'","environment":"dev"}'
    ELSE '{"correlationId":"'||action_id||'","message":"'||rationale||'","parameters":{},"rationale":"'||rationale||'","environment":"dev"}' END AS body
FROM pq WHERE status='Approved' AND type IN ('BlockIp','OpenTicket','Notify')"""
    q["ack_updates"] = X + """,
fin AS (SELECT alert_id, CASE WHEN count(*) FILTER (WHERE message='Policy pending approval.' OR status='Failed')>0
  THEN 'InProgress' ELSE 'Closed' END AS status FROM dry GROUP BY alert_id
  UNION ALL SELECT alert_id, 'InProgress' FROM norm WHERE reject_reason IS NOT NULL)
SELECT alert_id, CAST(0 AS INTEGER) AS step, 'Seen' AS status FROM fin
UNION ALL SELECT alert_id, CAST(1 AS INTEGER), status FROM fin"""
    q["audit_events"] = X + """,
pa AS (SELECT d.i, count(*) AS total, count(*) FILTER (WHERE d.status='Failed') AS failed,
  count(*) FILTER (WHERE d.status='Skipped') AS skipped, count(*) FILTER (WHERE d.status='DryRun') AS dry_run,
  count(*) FILTER (WHERE p.status='Approved') AS approved, count(*) FILTER (WHERE p.status='PendingApproval') AS pending,
  count(*) FILTER (WHERE p.status='Denied') AS denied FROM dry d JOIN po p ON p.i=d.i AND p.seq=d.seq GROUP BY d.i),
hh AS (SELECT i, alert_id, substr(sha256(siem_name||':'||alert_id),1,32) AS plan_id FROM hd),
ev AS (
  SELECT 'Execution' AS component, 'ExecutionStart' AS event_type, 'Execution started.' AS message, plan_id, NULL AS action_id,
    NULL AS action_type, NULL AS status, NULL AS executor, NULL AS total, NULL AS failed, NULL AS skipped, NULL AS dry_run,
    NULL AS approved, NULL AS pending, NULL AS denied FROM hh
  UNION ALL SELECT 'Execution','ActionResult',message,plan_id,action_id,type,status,executor,NULL,NULL,NULL,NULL,NULL,NULL,NULL
    FROM dry JOIN hh ON hh.i=dry.i WHERE NOT (status='Skipped' AND executor='ExecutionPipeline')
  UNION ALL SELECT 'Execution','ExecutionEnd','Execution finished.',plan_id,NULL,NULL,NULL,NULL,total,failed,skipped,dry_run,NULL,NULL,NULL
    FROM pa JOIN hh ON hh.i=pa.i
  UNION ALL SELECT 'Orchestrator','AlertProcessed','Alert '||alert_id||' processed.',plan_id,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,
    approved,pending,denied FROM pa JOIN hh ON hh.i=pa.i
  UNION ALL SELECT 'Orchestrator','NormalizationFailed','Normalization failed: InvalidOperationException: '||reject_reason,
    NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL FROM norm WHERE reject_reason IS NOT NULL)
SELECT component, event_type, message, plan_id, action_id, action_type, status, executor, CAST(total AS VARCHAR) AS total,
  CAST(failed AS VARCHAR) AS failed, CAST(skipped AS VARCHAR) AS skipped, CAST(dry_run AS VARCHAR) AS dry_run,
  CAST(approved AS VARCHAR) AS approved, CAST(pending AS VARCHAR) AS pending, CAST(denied AS VARCHAR) AS denied FROM ev"""
    q["audit_report"] = """
SELECT *, 'Total events: '||total_events||'|Action executions: '||action_executions||'|Failures: '||failures AS lines FROM (
SELECT count(*) AS total_events, count(*) FILTER (WHERE event_type IN ('error','purchase')) AS action_executions,
  count(*) FILTER (WHERE event_type='error') AS failures FROM events)"""
    q["audit_recent"] = """
SELECT 'recent' AS what, count(*) AS total_events, count(*) FILTER (WHERE event_type IN ('error','purchase')) AS action_executions,
  count(*) FILTER (WHERE event_type='error') AS failures FROM events
  WHERE ts >= TIMESTAMP '2024-01-01 23:50:00' AND ts <= TIMESTAMP '2024-01-02 00:00:00'
UNION ALL SELECT 'one', count(*), count(*) FILTER (WHERE event_type IN ('error','purchase')),
  count(*) FILTER (WHERE event_type='error') FROM events WHERE user_id=7"""
    q["page_since"] = """
WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id)-1 AS position, count(*) OVER () AS total
  FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00')
SELECT CAST(event_id AS VARCHAR) AS alert_id, position, CASE WHEN total>500 THEN '500' END AS next_cursor
FROM n WHERE position<500"""
    q["page_cursor"] = """
WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id)-1 AS position, count(*) OVER () AS total FROM events),
s AS (SELECT unnest([0, 200, 9900, 10000]) AS start)
SELECT CAST(event_id AS VARCHAR) AS alert_id, position,
  CASE WHEN total>start+200 THEN CAST(start+200 AS VARCHAR) END AS next_cursor
FROM n JOIN s ON position>=start AND position<start+200"""
    q["extreme_values"] = D + """
SELECT alert_id, CAST(greatest(0, least(100, xs + xc*10 + trunc(least(1e9, greatest(-1e9, xf*20))))) AS INTEGER) AS priority,
  CAST(greatest(0, least(100, trunc(least(1e9, greatest(-1e9, (1-xf)*30))))) AS INTEGER) AS risk_part,
  CAST(greatest(0, least(100, CAST(xc AS BIGINT)*5)) AS INTEGER) AS impact_part
FROM (SELECT alert_id, CASE i%3 WHEN 0 THEN CAST(2147483647 AS BIGINT) WHEN 1 THEN -2147483648 ELSE 50 END AS xs,
  CASE i%4 WHEN 0 THEN CAST(2000000000 AS BIGINT) WHEN 1 THEN -2000000000 ELSE 3 END AS xc,
  CASE i%5 WHEN 0 THEN 1e300 WHEN 1 THEN -1e300 WHEN 2 THEN 0.0 ELSE 0.7 END AS xf FROM hd)"""
    q["approved_execution"] = D + PENDING + """,
ap AS (SELECT p.* REPLACE (CASE WHEN p.status='PendingApproval' AND p.action_id IN
    (SELECT action_id FROM state WHERE status='Approved') THEN 'Approved' ELSE p.status END AS status) FROM po p),""" + RUN + "," + DRY.replace(
        "FROM po p", "FROM ap p") + " SELECT alert_id, seq, action_id, type, status, executor, message FROM dry"
    q["pull_failure_events"] = """
SELECT 'Orchestrator' AS component, 'PullFailed' AS event_type, 'Failed to pull alerts: timeout '||event_id AS message,
  CASE WHEN event_id%2=0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS cursor,
  CASE WHEN event_id%3=0 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||'Z' ELSE '' END AS since_utc
FROM events"""
    q["audit_ids"] = """
SELECT event_id AS event_no, CASE WHEN event_id%3=1 THEN 'e'||event_id ELSE substr(sha256('entry:c'||user_id||
  ':2024-02-01 00:00:00:Execution:'||CASE event_type WHEN 'error' THEN 'ActionResult' WHEN 'purchase' THEN 'actionresult' ELSE 'Note' END||
  ':m:{"k":"c'||user_id||'"}'),1,32) END AS entry_id FROM events"""
    q["log_files"] = r"""
WITH f AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, text FROM documents)
SELECT path, CAST(0 AS INTEGER) AS pos, md5('{"id":'||path||'}') AS document_md5, CAST(NULL AS VARCHAR) AS error FROM f WHERE doc_id%5 IN (0,1,2)
UNION ALL SELECT path, 1, md5('{"t":"x"}'), NULL FROM f WHERE doc_id%5=0
UNION ALL SELECT path, 1, md5('broken {'), 'Line is not valid JSON.' FROM f WHERE doc_id%5=2
UNION ALL SELECT path, 2, md5('{"b":2}'), NULL FROM f WHERE doc_id%5=2
UNION ALL SELECT path, 0, md5(path), 'Log file must contain a JSON object or array.' FROM f WHERE doc_id%5=3
UNION ALL SELECT path, CAST(generate_subscripts(l,1)-1 AS INTEGER), md5(unnest(l)), 'Line is not valid JSON.'
  FROM (SELECT path, list_transform(string_split(text, chr(10)), lambda x: 'x '||x) AS l FROM f WHERE doc_id%5=4)"""
    q["asset_files"] = """
SELECT s_suppkey AS file_no, 'host-'||s_suppkey AS host_id, 'srv-'||(s_suppkey%40) AS hostname,
  '10.0.'||(s_suppkey%8)||'.'||(s_suppkey%50) AS ip,
  CAST(CASE WHEN s_suppkey%3<>0 THEN s_nationkey%6 ELSE 0 END AS INTEGER) AS criticality,
  CASE WHEN s_suppkey%2=0 THEN 'prod' ELSE 'dev' END AS environment, 'owner'||s_nationkey AS owner,
  CASE WHEN s_suppkey%5<>0 THEN 'team'||(s_nationkey%3) END AS team FROM supplier"""
    q["identity_files"] = """
SELECT c_custkey AS file_no, 'u-'||c_custkey AS user_id, 'user'||c_custkey AS username,
  c_mktsegment='MACHINERY' AS privileged, c_mktsegment AS department, c_acctbal<0 AS is_service_account FROM customer"""
    q["intel_files"] = """
SELECT p_partkey AS file_no, '10.0.'||(p_partkey%8)||'.'||(p_partkey%50) AS src_ip,
  CASE WHEN p_partkey%3=0 THEN 'hash'||(p_partkey%30) END AS file_hash, CAST(p_size AS INTEGER) AS reputation,
  p_brand AS source, lower(p_type) AS tags FROM part"""
    q["audit_lines"] = """
SELECT 'e'||event_id AS entry_id, epoch_us(ts) AS ts_us, event_type, 'status=Failed' AS data
FROM events WHERE event_id%5 NOT IN (0,1) AND event_id%7<>0"""
    q["annotation_files"] = """
SELECT CAST(doc_id AS VARCHAR) AS dataset_id,
  CASE WHEN doc_id%4<>0 THEN 'Quality '||quality||', toxic '||toxic END AS detection_goal,
  CASE WHEN doc_id%3<>0 THEN '  <rule id="'||doc_id||'"/>'||chr(10) END AS completion,
  '<old id="'||doc_id||'"/>' AS rule_xml FROM labels"""
    q["knowledge_lines"] = """
SELECT doc_id AS line_no, CASE WHEN doc_id%3<>0 THEN source ELSE 'untitled' END AS title,
  md5(CASE WHEN doc_id%4<>0 THEN text ELSE '' END) AS content_md5, CASE WHEN doc_id%5<>0 THEN lang ELSE '' END AS tags,
  CAST(0 AS INTEGER) AS n_commands FROM documents WHERE doc_id%3<>0 OR doc_id%4<>0 OR doc_id%5<>0"""
    q["rejected_bodies"] = """
SELECT event_id, CASE WHEN event_id%3=0 THEN 'Empty body.' ELSE 'Malformed JSON.' END AS reject_reason
FROM events WHERE event_id%3<2"""
    q["scorer_replies"] = f"""
SELECT CAST(event_id AS VARCHAR) AS alert_id, CASE WHEN event_id%4=0 THEN 'h' ELSE '{K.SCORER_NO_HYPOTHESIS}' END AS summary,
  CASE WHEN event_id%4=0 THEN 'e|f' ELSE '' END AS details, CASE WHEN event_id%4=0 THEN 0.8::DOUBLE ELSE 1e300 END AS confidence,
  CAST(CASE WHEN event_id%4=0 THEN event_id%100 ELSE 2147483647 END AS INTEGER) AS severity
FROM events WHERE event_id%4 IN (0,3)"""
    q["dataset_statistics"] = """
SELECT (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id%2=0)) AS added_rows,
  (SELECT count(*)-count(DISTINCT text) FROM documents WHERE doc_id%2=0) AS duplicates_removed"""
    q["cycle_report"] = X + """
SELECT (SELECT count(*) FROM fx) AS pulled, (SELECT count(*) FROM v) AS processed,
  (SELECT count(*) FROM norm WHERE reject_reason IS NOT NULL) AS normalization_failed,
  CAST(0 AS BIGINT) AS planning_failed, CAST(0 AS BIGINT) AS policy_failed,
  count(*) FILTER (WHERE status='Failed') AS execution_failed, CAST(0 AS BIGINT) AS execution_succeeded,
  count(*) FILTER (WHERE status='Skipped') AS execution_skipped, count(*) FILTER (WHERE status='DryRun') AS execution_dry_run,
  count(DISTINCT action_id) FILTER (WHERE message='Policy pending approval.') AS approvals_created,
  '200' AS next_cursor FROM dry"""
    scen = """count(DISTINCT d.i) AS plans, count(*) FILTER (WHERE p.status='Approved') AS approved,
  count(*) FILTER (WHERE p.status='PendingApproval') AS pending, count(*) FILTER (WHERE p.status='Denied') AS denied,
  CAST(0 AS BIGINT) AS unknown_actions, CAST(0 AS BIGINT) AS succeeded, count(*) FILTER (WHERE d.status='Failed') AS failed,
  count(*) FILTER (WHERE d.status='Skipped') AS skipped, count(*) FILTER (WHERE d.status='DryRun') AS dry_run,
  count(DISTINCT d.action_id) FILTER (WHERE p.status='PendingApproval') AS approvals_created
  FROM dry d JOIN po p ON p.i=d.i AND p.seq=d.seq JOIN v ON v.i=d.i"""
    q["scenario_report"] = X + f"""
SELECT alert_type AS scenario, CAST(0 AS INTEGER) AS is_total, {scen} GROUP BY alert_type
UNION ALL SELECT NULL, CAST(1 AS INTEGER), {scen}"""
    q["case_state"] = CASES + """
SELECT case_id, 'summary '||max_by(seq,(ts,seq)) FILTER (WHERE kind='open') AS summary,
  CAST(max_by(seq,(ts,seq)) FILTER (WHERE kind='open')%100 AS VARCHAR) AS severity,
  'wazuh:'||max_by(seq,(ts,seq)) FILTER (WHERE kind='open') AS alert_key,
  coalesce(max_by(CASE WHEN seq%2=0 THEN 'FalsePositive' ELSE 'Closed' END,(ts,seq)) FILTER (WHERE kind='close'),'Open') AS status,
  epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us FROM live GROUP BY case_id"""
    q["case_evidence"] = CASES + """
SELECT case_id, seq, epoch_us(ts) AS ts_us, 'seen '||seq AS description FROM live WHERE kind='evidence'"""
    q["case_event_log"] = CASES + """
SELECT case_id, seq, CASE WHEN kind='open' AND (ts,seq)=first THEN 'CaseCreated' WHEN kind='open' THEN 'CaseUpdated'
  WHEN kind='evidence' THEN 'EvidenceAdded' ELSE 'CaseClosed' END AS event_type,
  CASE WHEN kind='open' AND (ts,seq)=first THEN 'Case created for plan '||case_id||'.'
    WHEN kind='open' THEN 'Case updated for plan '||case_id||'.' WHEN kind='evidence' THEN 'seen '||seq
    ELSE 'Case closed as '||CASE WHEN seq%2=0 THEN 'FalsePositive' ELSE 'Closed' END||'.' END AS message FROM live"""
    q["case_openings"] = D + f""",
pc AS (SELECT i, {counts} FROM po GROUP BY i)
SELECT substr(sha256(siem_name||':'||alert_id),1,32) AS case_id,
  {summary}||' | Approved='||approved||', Pending='||pending||', Denied='||denied||' | Severity='||sev||', Confidence='||printf('%.2f',conf) AS summary,
  CAST(sev AS VARCHAR) AS severity, siem_name||':'||alert_id AS alert_key FROM hd JOIN pc ON pc.i=hd.i"""
    q["dataset_rows"] = """
SELECT doc_id, md5(text) AS text_md5, lang, source, '{"n": '||n_chars||', "l": "'||lang||'"}' AS meta,
  CASE WHEN n_chars%2=0 THEN 'True' ELSE 'False' END AS even, '' AS dotted FROM documents"""
    q["dataset_append"] = """
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, md5(text) AS text_md5
FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id%2=0) GROUP BY text"""
    q["dataset_file"] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text,'')) AS text_md5, coalesce(lang,'') AS lang FROM documents"""
    q["dataset_dedupe"] = """
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, md5(text) AS text_md5
FROM documents GROUP BY text"""
    q["dataset_duplicates"] = "SELECT count(*)-count(DISTINCT text) AS duplicates_removed FROM documents"
    logs = _logs()
    q["heuristic_candidates"] = logs + """
SELECT no AS heuristic_no, id AS dataset_id, timestamp, name AS heuristic, severity, goal AS detection_goal,
  descr AS rule_description, full_log AS log_excerpt, completion AS example_completion FROM hn"""
    q["heuristic_first"] = logs + """
SELECT id AS dataset_id, name AS heuristic, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY no ORDER BY ts, i) AS rn FROM hn) WHERE rn<=20"""
    q["heuristic_counts"] = logs + " SELECT name AS heuristic, count(*) AS n FROM hn GROUP BY name"
    q["response_plans"] = logs + f"""
SELECT id AS dataset_id, name AS heuristic,
  CASE WHEN plain THEN 'agent '||(u%30) ELSE coalesce(aname, aid,
    CASE WHEN aip IS NULL THEN '{{}}' ELSE '{{"ip":"'||aip||'"}}' END) END AS host,
  CASE WHEN NOT plain THEN aip END AS ip, CAST(i%100 AS VARCHAR) AS rule_id, descr AS rule_description, severity,
  full_log AS log_excerpt, {_response_case()} AS actions FROM hn"""
    q["ip_change"] = logs + " SELECT id, agent_key, previous_ip, aip AS agent_ip FROM chg"
    q["stream_addresses"] = logs.replace("BY agent_key ORDER BY ts, i)", "BY agent_key ORDER BY ts, id)") \
        + " SELECT id, agent_key, previous_ip, aip AS agent_ip FROM chg"
    q["stream_cycles"] = q["cycle_report"].replace(",\n  '200' AS next_cursor", "")
    q["stream_cases"] = q["case_state"]
    q["stream_dataset"] = q["dataset_dedupe"]
    q["dataset_commits"] = """
SELECT CAST(min(doc_id) AS VARCHAR) AS doc_id, md5(coalesce(text,'')) AS text_md5,
  arg_min(coalesce(lang,''), doc_id) AS lang FROM documents GROUP BY coalesce(text,'')"""
    docs = """WITH lb AS (SELECT l.doc_id AS k, quality, toxic, d.text, d.source, d.n_chars,
  CASE WHEN l.doc_id%3=0 THEN '{"id":"'||(l.doc_id%50)||'"}' WHEN l.doc_id%3=1 THEN 'plain rule' ELSE '' END AS rule
  FROM labels l JOIN documents d ON d.doc_id=l.doc_id)"""
    q["training_pairs"] = docs + """
SELECT CAST(k AS VARCHAR) AS dataset_id, md5(concat_ws(chr(10)||chr(10), 'You are an expert Wazuh detection engineer.',
  'Detection goal: '||CASE WHEN k%4<>0 THEN 'Quality '||quality||', toxic '||toxic ELSE 'Detect suspicious activity.' END,
  'Sample log event:',
  concat_ws(chr(10), 'timestamp: t'||n_chars, CASE WHEN rule<>'' THEN 'rule: '||rule END,
    'agent: {"name":"'||source||'"}', 'location: '||source, CASE WHEN text<>'' THEN 'full_log: '||text END),
  CASE WHEN rule<>'' THEN 'Current description: '||rule END,
  'Produce a precise Wazuh custom rule (XML) that would detect this behavior.')) AS prompt_md5,
  CASE WHEN k%3<>0 THEN '<rule id="'||k||'"/>' ELSE '<old id="'||k||'"/>' END AS completion FROM lb"""
    q["annotations_missing"] = """
SELECT CAST(doc_id AS VARCHAR) AS dataset_id FROM (SELECT doc_id FROM labels
  UNION ALL SELECT doc_id+1000000000 FROM labels WHERE doc_id%5=0)
WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
    p_ = _strip("CASE WHEN role='user' AND text<>'' THEN text WHEN turn%3=0 THEN ' goal ' ELSE '' END")
    c_ = _strip("CASE WHEN role<>'user' THEN text ELSE '' END")
    q["training_text"] = f"""
SELECT conv_id, turn, md5(concat_ws(chr(10)||chr(10), nullif({p_},''), nullif({c_},''))) AS text_md5 FROM conversations"""
    q["log_extracts"] = docs + """
SELECT CAST(k AS VARCHAR) AS dataset_id, CAST(k AS VARCHAR) AS id, 't'||n_chars AS timestamp,
  CASE WHEN k%3=0 THEN rule WHEN k%3=1 THEN '"plain rule"' ELSE '{}' END AS rule,
  '{"name":"'||source||'"}' AS agent, source AS location, md5(left(text,1024)) AS log_md5,
  CAST(length(left(text,1024)) AS INTEGER) AS log_chars FROM lb"""
    js = "CASE WHEN {0} IS NULL THEN '' ELSE '\"{1}\":\"'||{0}||'\",' END"
    ents = "||".join(js.format(c, n) for c, n in
                     [("host_id", "hostId"), ("username", "username"), ("src_ip", "srcIp"),
                      ("file_hash", "fileHash")])
    q["request_table"] = E + f"""
SELECT alert_id, '{{"correlationId":"'||alert_id||'","alert":{{"sourceSiem":"'||siem_name||'","alertId":"'||alert_id||
  '","type":"'||alert_type||'","ruleName":"'||rule_name||'","severity":'||severity||
  ',"timestampUtc":"'||strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||'Z","entities":{{'||rtrim({ents}, ',')||
  '}},"context":{{"environment":"'||coalesce(environment,'unknown')||'","assetCriticality":'||crit||',"privileged":'||
  CASE WHEN priv THEN 'true' ELSE 'false' END||'}}}}}}' AS request FROM enr"""
    score_alert = f"""'{{"sourceSiem":"'||siem_name||'","alertId":"'||alert_id||
  '","type":"'||alert_type||'","ruleName":"'||rule_name||'","severity":'||severity||
  ',"timestampUtc":"'||strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||'Z","entities":{{'||rtrim({ents}, ',')||
  '}},"context":{{"environment":"'||coalesce(environment,'unknown')||'","assetCriticality":'||crit||',"privileged":'||
  CASE WHEN priv THEN 'true' ELSE 'false' END||'}}}}'"""
    q["score_prompts"] = E + f"""
SELECT alert_id, md5({_quote(K.SCORER_REQUEST_INTRO)}||chr(10)||chr(10)||'Alert:'||chr(10)||{score_alert}||chr(10)) AS prompt_md5 FROM enr"""
    text = lambda c: f"'\"'||{c}||'\"'"
    flag = lambda c: f"CASE WHEN {c} THEN 'true' WHEN NOT {c} THEN 'false' END"
    entities = _object(
        hostname=text("hostname"), hostId=text("host_id"), username=text("username"), userId=text("user_id"),
        srcIp=text("src_ip"), dstIp="CASE WHEN i%5<>0 AND i%3=1 THEN '\"192.168.0.'||(i%9)||'\"' END",
        domain="CASE WHEN i%7=2 THEN '\"d'||(u%5)||'.example\"' END",
        processName="CASE WHEN et='purchase' AND i%2=0 THEN '\"proc'||(i%6)||'.exe\"' END",
        processPath="CASE WHEN et='purchase' THEN '\"/bin/proc'||(i%6)||'\"' END", fileHash=text("file_hash"),
    )
    asset = _object(
        asset_id=text("asset_id"), criticality="criticality", environment=text("environment"),
        roles="'[\"'||concat_ws('\",\"', owner, team)||'\"]'",
    )
    identity = _object(
        user_id=text("ident_id"), privileged=flag("privileged"), department=text("department"),
        groups="CASE WHEN service THEN '[\"service_account\"]' END",
    )
    intel = _object(reputation="reputation", matches="'[\"'||tag||'\"]'")
    tags = _object(
        asset_owner=text("owner"), asset_team="CASE WHEN apos IS NOT NULL THEN '\"'||coalesce(team,'')||'\"' END",
        department=text("department"), is_service_account="CASE WHEN service THEN '\"True\"' WHEN NOT service THEN '\"False\"' END",
        ti_source=text("source"),
    )
    context = _object(
        asset=f"CASE WHEN apos IS NOT NULL THEN {asset} END", identity=f"CASE WHEN dpos IS NOT NULL THEN {identity} END",
        threatIntel=f"CASE WHEN tpos IS NOT NULL THEN {intel} END",
        tags=tags, assetCriticality="crit", privileged=flag("priv"), environment=text("coalesce(environment,'unknown')"),
    )
    planned = _object(
        sourceSiem=text("siem_name"), alertId=text("alert_id"), type=text("alert_type"), ruleName=text("rule_name"),
        timestampUtc=text("strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||'Z'"), severity="severity", entities=entities, context=context,
    )
    # Parameters stand in the order in which the scorer names them.
    params = """CASE WHEN alert_type='MalwareHashOnHost' THEN
    '{"host_id":"'||coalesce(host_id,'host-1')||'","file_hash":"'||coalesce(file_hash,'hash')||'"}' ELSE '{"'||replace(replace(rec_params,'=','":"'),'|','","')||'"}' END"""
    action = _object(type=text("rec_type"), params=params, rationale=text("rec_why"))
    assessed = _object(
        confidence="conf", severity="sev", hypothesis=text("hypothesis"), evidence="'[\"scenario:'||alert_type||'\"]'",
        recommendedActions=f"CASE WHEN rec_type IS NOT NULL THEN '['||{action}||']' END",
    )
    shape = json.dumps(K.PLANNER_REPLY_SHAPE, indent=2)
    q["plan_request_table"] = S + f""",
rq AS (SELECT alert_id, {planned} AS alert, {assessed} AS assessment FROM sc)
SELECT alert_id, '{{"alert":'||alert||',"assessment":'||assessment||',"planning":{{"environment":"dev","dryRun":true,"nowUtc":"2024-02-01T00:00:00.000000Z"}}}}' AS request,
  md5({_quote(K.PLANNER_REQUEST_INTRO + chr(10) + shape + chr(10) * 2 + K.PLANNER_REQUEST_OUTRO + chr(10) * 2 + 'Alert:' + chr(10))}||alert||
    chr(10)||chr(10)||'Assessment:'||chr(10)||assessment||chr(10)) AS prompt_md5 FROM rq"""
    q["rule_request_table"] = f"""
SELECT conv_id, turn, md5('{{"detection_goal":'||CAST(to_json(text) AS VARCHAR)||',"siem":"{K.NESTED_SIEM}","example_events":'||
  CASE WHEN turn%2=0 THEN CAST(to_json(role) AS VARCHAR) ELSE 'null' END||',"existing_rules":'||
  CASE WHEN conv_id%3=0 THEN '"<rule id=\\"1\\">\\n</rule>"' ELSE 'null' END||',"existing_logs":null}}') AS request_md5 FROM conversations"""
    plain = "regexp_replace(text, '[{}]', '', 'g')"
    q["reply_objects"] = f"""
SELECT conv_id, turn, CASE WHEN (conv_id+turn)%3=0 THEN '{{"severity":7,"note":{{"a":1}}}}' END AS found,
  CASE WHEN (conv_id+turn)%3=1 THEN md5({_strip(plain + " || ' {\"severity\": 7 } and {\"b\": 2}'")})
    WHEN (conv_id+turn)%3=2 THEN md5({_strip(plain)}) END AS message_md5 FROM conversations"""
    know = f"""WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id%10=3 THEN '' WHEN item_id%10=7 THEN 'zzqx qqzx'
    ELSE text END AS query FROM benchmark),
tk AS (SELECT query_id, query, list_filter(string_split_regex(lower(query), '{_WS}+'), lambda t: t<>'') AS toks FROM q),
en AS (SELECT doc_id AS pos, source AS title, text AS content, lower(source||' '||text||' '||lang) AS hay FROM documents),
scx AS (SELECT query_id, query, pos, title, content, CAST(len(list_filter(toks, lambda t: contains(hay, t))) AS INTEGER) AS score FROM tk, en),
mx AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM scx),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM mx WHERE score>0 OR best=0)"""
    q["knowledge_search"] = know + " SELECT query_id, pos, score, rank FROM top WHERE rank<=5"
    lines_ = r"string_split_regex(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
    q["runbooks"] = know + f""",
ln AS (SELECT *, list_filter(list_transform({lines_}, lambda x: {_strip('x')}), lambda x: x<>'')[1] AS line FROM top WHERE rank<=5),
rb AS (SELECT query_id, any_value(query) AS query,
  string_agg(title,'|' ORDER BY rank) AS entries,
  string_agg('# - '||title||': '||coalesce(line,title), chr(10) ORDER BY rank) AS ents,
  string_agg('run '||pos,'|' ORDER BY rank) AS cmds FROM ln GROUP BY query_id),
rc AS (SELECT *, query_id%4=1 AS threat,
  CASE WHEN query_id%4=1 AND query_id%10>=7 THEN 'python' ELSE 'bash' END AS language,
  CASE WHEN query_id%4=1 THEN CASE WHEN query_id%3=0 THEN 'stop it' ELSE 'echo "Handling threat: '||
    CASE WHEN query_id%8=1 THEN 'bad login' ELSE 'unknown threat' END||'"' END ELSE cmds END AS commands FROM rb)
SELECT query_id, language, commands, entries, md5({_strip("'#!/usr/bin/env '||language||chr(10)||'# Script: automation-script'||chr(10)||'# Topic: '||query||chr(10)||chr(10)||'# Knowledge base entries:'||chr(10)||ents||chr(10)||chr(10)||'# Execution steps'||chr(10)||replace(commands,'|',chr(10))")}||chr(10)) AS script_md5 FROM rc"""
    return q
