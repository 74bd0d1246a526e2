"""Fixed values.

Everything below is data that has to equal the published behaviour for results
to match: names, thresholds, tables, keyword lists and message texts.
"""

# --- enums (ordinal order matters for the final action sort) -----------------
ACTION_TYPES = [
    "BlockIp",
    "UnblockIp",
    "IsolateHost",
    "UnisolateHost",
    "DisableUser",
    "EnableUser",
    "KillProcess",
    "QuarantineFile",
    "OpenTicket",
    "Notify",
    "CollectForensics",
]
STRATEGIES = ["ObserveMore", "NotifyOnly", "Contain", "ContainAndCollect", "EscalateToHuman"]

ENTITY_FIELDS = [
    "hostname",
    "host_id",
    "username",
    "user_id",
    "src_ip",
    "dst_ip",
    "domain",
    "process_name",
    "process_path",
    "file_hash",
]

# --- entity candidates of the nested payload profile, in order ----------------
NESTED_CANDIDATES = {
    "src_ip": ["data.srcip", "data.src_ip", "srcip", "src_ip", "agent.ip"],
    "dst_ip": ["data.dstip", "data.dst_ip", "dstip", "dst_ip"],
    "hostname": ["agent.name", "agent.hostname", "manager.name", "hostname"],
    "host_id": ["agent.id", "agent_id", "data.host_id", "data.hostId"],
    "username": [
        "data.user",
        "data.username",
        "data.srcuser",
        "data.dstuser",
        "data.account",
        "username",
    ],
    "user_id": ["data.user_id", "data.userid", "user_id"],
    "domain": ["data.domain", "domain"],
    "process_name": ["data.process_name", "data.process", "data.command", "data.image"],
    "process_path": ["data.process_path", "data.path", "data.image_path"],
    "file_hash": ["data.file_hash", "data.hash", "data.sha256", "data.md5", "file_hash"],
}
NESTED_SIEM = "wazuh"
FLAT_SIEM = "simulator"
DEFAULT_SEVERITY = 50

NO_MAPPER = "No mapper could be resolved for the provided RawAlert."
INVALID_PREFIX = "NormalizedAlert validation failed: "
ERR_ALERT_ID = "AlertId is required."
ERR_SIEM = "SourceSiem is required."
ERR_ENTITY = "At least one entity must be present (host/user/ip)."

# --- action catalog: rollback, approval, risk, impact, required ---------------
ACTION_CATALOG = {
    "BlockIp": (True, True, 55, 30, ["src_ip"]),
    "UnblockIp": (False, False, 10, 5, ["src_ip"]),
    "IsolateHost": (True, True, 70, 60, ["hostname", "host_id"]),
    "UnisolateHost": (False, False, 15, 10, ["hostname", "host_id"]),
    "DisableUser": (True, True, 65, 50, ["username", "user_id"]),
    "EnableUser": (False, False, 15, 10, ["username", "user_id"]),
    "KillProcess": (False, True, 85, 85, ["host_id", "process_name"]),
    "QuarantineFile": (False, True, 85, 85, ["host_id", "file_hash"]),
    "OpenTicket": (False, False, 5, 5, []),
    "Notify": (False, False, 5, 5, []),
    "CollectForensics": (False, True, 35, 20, []),
}
UNKNOWN_STATIC = (False, True, 50, 50, [])

# Parameter rules that replace the plain "all required" rule: every group needs
# one non-blank key.
PARAMETER_GROUPS = {
    "KillProcess": [["host_id", "hostId", "hostname"], ["process_name", "processName", "pid"]],
    "QuarantineFile": [["host_id", "hostId"], ["file_hash", "fileHash", "file_path", "filePath"]],
}
EITHER_KEY_LISTS = [["username", "user_id"], ["hostname", "host_id"]]

ROLLBACK_OF = {"BlockIp": "UnblockIp", "IsolateHost": "UnisolateHost", "DisableUser": "EnableUser"}

SELECTION_ORDER = [
    "Notify",
    "OpenTicket",
    "BlockIp",
    "DisableUser",
    "IsolateHost",
    "CollectForensics",
]
# Entities an action needs before it may be selected (any of them).
ENTITY_NEEDS = {
    "BlockIp": ["src_ip"],
    "UnblockIp": ["src_ip"],
    "IsolateHost": ["hostname", "host_id"],
    "UnisolateHost": ["hostname", "host_id"],
    "DisableUser": ["username", "user_id"],
    "EnableUser": ["username", "user_id"],
}

TICKET_TEXT = "Create a tracking ticket."
NOTIFY_TEXT = "Notify analysts."
ESCALATE_TEXT = "Escalate to human analyst."
BLOCK_TEXT = "Block suspicious source IP."
DISABLE_TEXT = "Disable user account."
ISOLATE_TEXT = "Isolate host."
FORENSICS_TEXT = "Collect forensic artifacts."
RECOMMENDED_TEXT = "Recommended action."

# --- scenario scores: confidence, severity ------------------------------------
SCENARIO_SCORES = {
    "PortScanFromIp": (0.85, 70),
    "BruteForceUser": (0.8, 65),
    "MalwareHashOnHost": (0.9, 85),
    "SuspiciousProcessOnHost": (0.75, 60),
    "EdgeMissingParams": (0.7, 55),
    "EdgeMalformedAlert": (0.2, 10),
    "BenignNoise": (0.2, 15),
}
SCENARIO_DEFAULT = (0.5, 40)
BENIGN_SCENARIOS = ["BenignNoise", "EdgeMalformedAlert"]
BENIGN_TEXT = "Likely benign noise."
SUSPICIOUS_TEXT = "Suspicious activity detected."
# scenario -> action, {parameter: (entity, value used when the entity is null)}, rationale
SCENARIO_ACTIONS = {
    "PortScanFromIp": ("BlockIp", {"src_ip": ("src_ip", "10.0.0.1")}, "Block scanning IP."),
    "BruteForceUser": (
        "DisableUser",
        {"username": ("username", "user1")},
        "Disable targeted user.",
    ),
    "MalwareHashOnHost": (
        "QuarantineFile",
        {"host_id": ("host_id", "host-1"), "file_hash": ("file_hash", "hash")},
        "Quarantine malware.",
    ),
    "SuspiciousProcessOnHost": (
        "KillProcess",
        {"host_id": ("host_id", "host-1"), "process_name": ("process_name", "powershell.exe")},
        "Kill suspicious process.",
    ),
}

# --- keyword scorer: words, severity, confidence, hypothesis, evidence --------
KEYWORD_SCORES = [
    (["ransomware", "trojan", "malware"], 85, 0.85, "Likely malware activity.", "keyword:malware"),
    (
        ["brute force", "bruteforce", "failed login"],
        60,
        0.7,
        "Possible brute-force attempts.",
        "keyword:bruteforce",
    ),
    (["port scan", "scan"], 55, 0.65, "Possible scanning activity.", "keyword:scan"),
    (["benign"], 20, 0.2, "Likely benign noise.", "keyword:benign"),
]
SEVERITY_SCORE = (0.5, "Severity-based assessment.", "source:severity")
DEFAULT_SCORE = (40, 0.5, "Heuristic assessment.", "source:default")

# --- score fallbacks: confidence, severity, hypothesis, evidence --------------
SCORER_UNAVAILABLE = (0.3, 30, "scorer unavailable", [])
SCORER_ERROR = (0.2, 10, "Scoring failed: {error}")
SCORER_LAST_RESORT = (0.5, 40, "fallback", ["fallback"])
SCORER_NO_HYPOTHESIS = "scorer response"

# --- policy defaults -----------------------------------------------------------
POLICY_DEFAULTS = {
    "minConfidenceForAutonomy": 0.60,
    "riskApprovalThreshold": 70,
    "impactApprovalThreshold": 70,
    "maxActionsPerPlan": 6,
    "criticalAssetThreshold": 4,
    "safeLowConfidenceActions": ["OpenTicket", "Notify"],
    "requireApprovalInProd": ["DisableUser", "IsolateHost", "QuarantineFile", "KillProcess"],
    "requireApprovalOnPrivilegedIdentities": ["DisableUser"],
    "requireApprovalOnCriticalAssets": ["IsolateHost", "DisableUser"],
    "forbidActionsOnPrivilegedIdentities": ["DisableUser"],
    "forbidActionsOnCriticalAssets": ["KillProcess", "QuarantineFile"],
    "forbiddenActionsByEnvironment": {"prod": []},
}
APPROVAL_REASON = "Policy approval required."

# --- executors: types, name, any-of keys, missing text, reference prefix ------
EXECUTORS = [
    (
        ["BlockIp", "UnblockIp"],
        "FirewallExecutor",
        ["src_ip"],
        "Missing required parameter 'src_ip'.",
        "FW-",
    ),
    (
        ["DisableUser", "EnableUser"],
        "UserAccessExecutor",
        ["username", "user_id"],
        "Missing required parameter 'username' or 'user_id'.",
        "USER-",
    ),
    (
        ["IsolateHost", "UnisolateHost"],
        "HostIsolationExecutor",
        ["hostname", "host_id"],
        "Missing required parameter 'hostname' or 'host_id'.",
        "HOST-",
    ),
    (["OpenTicket"], "TicketingExecutor", [], "", "TICKET-"),
    (["Notify"], "NotificationExecutor", [], "", "NOTIFY-"),
]
EXECUTED_TEXT = {
    "BlockIp": "IP blocked (stub).",
    "UnblockIp": "IP unblocked (stub).",
    "DisableUser": "User disabled (stub).",
    "EnableUser": "User enabled (stub).",
    "IsolateHost": "Host isolated (stub).",
    "UnisolateHost": "Host unisolate (stub).",
    "OpenTicket": "Ticket created (stub).",
    "Notify": "Notification sent (stub).",
}
PIPELINE_NAME = "ExecutionPipeline"
SKIP_PENDING = "Policy pending approval."
SKIP_DENIED = "Denied by policy."
SKIP_OTHER = "Not approved by policy."
NO_EXECUTOR = "No executor registered."
DRY_RUN_TEXT = "Dry-run: execution skipped."
DRY_ROLLBACK_TEXT = "Dry-run: rollback skipped."
NO_ROLLBACK = "No rollback action found."
STOP_NOTE = "Stopped on first failure."
FIREWALL_TTL_SECONDS = 3600

# --- keyword heuristics, in order ----------------------------------------------
HEURISTICS = [
    {
        "name": "noise_auth_success",
        "fields": ["rule"],
        "keywords": ["authentication success", "Windows logon success"],
        "goal": "Treat this Windows authentication success as routine noise before raising the alert again.",
        "severity": "noise",
        "completion": '<group name="noise"><rule id="100000" level="1"><description>Routine authentication success</description></rule></group>',
    },
    {
        "name": "powershell_usage",
        "fields": ["rule", "full_log"],
        "keywords": ["powershell", ".ps1", ".psm1"],
        "goal": "Flag PowerShell activity, since PowerShell usage often indicates script-based abuse in your environment.",
        "severity": "high",
        "completion": '<group name="custom_sysmon_rules,process_injection"><rule id="100650" level="12"><description>Suspicious PowerShell invocation</description></rule></group>',
    },
    {
        "name": "ssl_usage",
        "fields": ["rule", "full_log"],
        "keywords": ["ssl", "tls", "https://", "443"],
        "goal": "Investigate SSL/TLS usage that might be hiding command-and-control or data exfiltration.",
        "severity": "medium",
        "completion": '<group name="custom_windows_rules,network"><rule id="100651" level="10"><description>Unusual SSL/TLS traffic</description></rule></group>',
    },
    {
        "name": "root_execution",
        "fields": ["full_log"],
        "keywords": ["user=root", "sudo", "run as root"],
        "goal": "High alert when root executes a program—track what commands are being issued as root.",
        "severity": "critical",
        "completion": '<group name="custom_unix_rules,root"><rule id="100652" level="13"><description>Program execution as root</description></rule></group>',
    },
    {
        "name": "remote_access",
        "fields": ["rule", "full_log"],
        "keywords": [
            "remote shell",
            "remote access",
            "sshd",
            "rdesktop",
            "mstsc",
            "winrm",
            "remote desktop",
        ],
        "goal": "Treat remote access sessions as high risk until verified, especially when they appear without prior authorization.",
        "severity": "high",
        "completion": '<group name="local,remote_access"><rule id="100660" level="13"><description>Unusual remote access activity</description></rule></group>',
    },
    {
        "name": "copy_sensitive",
        "fields": ["full_log"],
        "keywords": ["/etc/passwd", "/etc/shadow", "/etc/group"],
        "goal": "Copying sensitive files (passwd/shadow/group) should raise a high alert even if the copy command looks normal.",
        "severity": "high",
        "completion": '<group name="custom_unix_rules,syscheck"><rule id="100653" level="13"><description>Copy of sensitive credential files</description></rule></group>',
    },
    {
        "name": "unsigned_install",
        "fields": ["rule", "full_log"],
        "keywords": ["installation completed", "installed product"],
        "exclude": ["signed", "Microsoft", "verified"],
        "goal": "Treat installs without a signature or vendor stamp as high risk.",
        "severity": "high",
        "completion": '<group name="local,software_install"><rule id="100654" level="12"><description>Unsigned installer executed</description></rule></group>',
    },
    {
        "name": "signed_install",
        "fields": ["rule", "full_log"],
        "keywords": ["signed by", "verified", "digital signature"],
        "goal": "Signed installs are mid/low priority but worth auditing for unexpected binaries.",
        "severity": "medium",
        "completion": '<group name="local,software_install"><rule id="100655" level="8"><description>Signed installer seen</description></rule></group>',
    },
    {
        "name": "self_signed",
        "fields": ["rule", "full_log"],
        "keywords": ["self-signed", "self signed"],
        "goal": "Self-signed binaries/certificates are suspicious; track the origin.",
        "severity": "high",
        "completion": '<group name="local,software_install"><rule id="100656" level="12"><description>Self-signed binary detected</description></rule></group>',
    },
    {
        "name": "login_geo_anomaly",
        "matcher": "ip_change",
        "goal": "Raise a very high alert when the same account authenticates from differing IPs within a short period.",
        "severity": "critical",
        "completion": '<group name="custom_windows_rules,authentication"><rule id="100657" level="14"><description>Account used from multiple locations quickly</description></rule></group>',
    },
    {
        "name": "privilege_escalation",
        "fields": ["rule", "full_log"],
        "keywords": ["privilege escalation", "Privilege Escalation"],
        "goal": "Confirm whether this privilege escalation alert is real or just noise from scripted activity.",
        "severity": "high",
        "completion": '<group name="local,sudo"><rule id="100658" level="13"><description>Privilege escalation activity</description></rule></group>',
    },
    {
        "name": "rootcheck_trojan",
        "fields": ["rule", "full_log"],
        "keywords": ["rootcheck", "trojaned version"],
        "goal": "Treat Trojaned system utilities flagged by rootcheck as high-risk detections.",
        "severity": "high",
        "completion": '<group name="custom_rules,rootcheck"><rule id="100659" level="12"><description>Rootcheck reported trojaned binary</description></rule></group>',
    },
]

RESPONSE_ACTIONS = {
    "critical": [
        "Isolate the affected host from the network (disable interfaces or remove from VPN).",
        "Notify SOC immediately and document the detection details.",
        "Capture volatile memory/log snapshots before the host is rebooted.",
    ],
    "high": [
        "Block the source IP at the firewall or host-based firewall.",
        "Stage the host for forensic triage (collect disk image, eventlogs).",
        "Up the logging verbosity and monitor for follow-on activity.",
    ],
    "medium": [
        "Correlate with other detections to confirm impact.",
        "Notify the owner/team and continue to monitor the host.",
    ],
    "low": [
        "Log the event for record keeping and review during the next shift.",
        "Confirm whether the behavior is expected before escalating.",
    ],
    "noise": [
        "Mark the detection as noise to reduce future alert volume.",
        "Tune the matching rule instead of escalating the incident.",
    ],
    "default": [
        "Document the detection and hand off to the analyst queue for investigation.",
    ],
}
CANDIDATE_EXCERPT = 200
RESPONSE_EXCERPT = 400
EXTRACT_EXCERPT = 1024

# --- training pairs -------------------------------------------------------------
PAIR_FIELDS = ["timestamp", "rule", "agent", "location", "full_log"]
PAIR_INTRO = "You are an expert Wazuh detection engineer."
PAIR_GOAL_DEFAULT = "Detect suspicious activity."
PAIR_OUTRO = "Produce a precise Wazuh custom rule (XML) that would detect this behavior."

# --- request texts for offline inference ----------------------------------------
SCORER_REQUEST_INTRO = (
    "You are a SOC threat scoring assistant. "
    "Return JSON with fields: severity (0-100 int), confidence (0-1 float), "
    "hypothesis (string), evidence (array of strings). "
    "Be concise and deterministic."
)
PLANNER_REQUEST_INTRO = (
    "You are a SOC response planner. Return ONLY a JSON object that matches this schema:"
)
PLANNER_REQUEST_OUTRO = (
    "Given alert and assessment below, produce a safe, policy-friendly plan."
)
PLANNER_REPLY_SHAPE = {
    "planId": "string",
    "strategy": "|".join(STRATEGIES),
    "priority": "0-100 int",
    "summary": "string",
    "actions": [
        {
            "type": "|".join(ACTION_TYPES),
            "risk": "0-100 int",
            "expectedImpact": "0-100 int",
            "reversible": "true|false",
            "parameters": {"key": "value"},
            "rationale": "string",
        }
    ],
    "rollbackActions": [],
    "rationale": ["string"],
    "tags": {"key": "value"},
}

# --- runbook text ----------------------------------------------------------------
SHEBANGS = {
    "bash": "#!/usr/bin/env bash",
    "sh": "#!/usr/bin/env sh",
    "powershell": "#!/usr/bin/env pwsh",
}
RUNBOOK_ENTRIES = "# Knowledge base entries:"
RUNBOOK_STEPS = "# Execution steps"
RUNBOOK_EMPTY = "# TODO: populate script commands manually."
THREAT_PYTHON_SEVERITY = 7
