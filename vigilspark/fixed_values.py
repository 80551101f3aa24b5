"""Fixed values.

Word lists, thresholds, labels and weights that results depend on. They are stated here
once, in plain form; all logic lives in the operator modules.
"""

# --- events -----------------------------------------------------------------------------
SEVERITY_NAMES = {"low": 3, "medium": 6, "high": 10, "critical": 15}
EVENT_TEXT_LIMITS = {
    # column: (min length, max length, required)
    "event_id": (1, 256, True),
    "source": (1, 128, True),
    "event_type": (1, 128, True),
    "message": (1, 10000, True),
    "host": (0, 255, False),
    "user": (0, 255, False),
    "source_ip": (0, 64, False),
    "destination_ip": (0, 64, False),
}
ACTIVITY_OPERATIONS = [
    "dataset_opened", "dataset_read", "sensitive_column_access", "bulk_access",
    "dataset_modified", "dataset_copied", "dataset_exported", "dataset_deleted",
    "schema_changed",
]

# --- redaction --------------------------------------------------------------------------
REDACTED = "[REDACTED]"
TELEMETRY_KEYWORDS = [
    "password", "passwd", "secret", "token", "api_key", "apikey", "authorization",
    "bearer", "credential", "private_key", "session", "cookie",
]
CASE_KEYWORDS = [
    "password", "passwd", "secret", "token", "api_key", "apikey", "auth", "bearer",
    "credential", "private_key",
]
RESPONSE_KEYWORDS = [
    "password", "passwd", "secret", "token", "api_key", "apikey", "auth",
    "authorization", "bearer", "credential", "private_key", "session", "cookie",
]
PAIR_PATTERN = (
    r"\b(password|passwd|secret|token|api[_-]?key|apikey|authorization|bearer|credential|"
    r"private[_-]?key|session|cookie)\b\s*[:=]\s*[^\s,;]+"
)

# --- detection --------------------------------------------------------------------------
HIGH_SEVERITY = 10
PROCESS_INDICATORS = [
    "/tmp/", "\\temp\\", "powershell -enc", "cmd.exe /c", "cmd /c", "/dev/shm/",
]
AUTH_FAILURE_TYPES = ["authentication_failure", "login_failure"]
PRIVILEGE_TYPES = ["privilege_escalation", "runas", "sudo"]
DATASET_SOURCE = "dataset_activity"
BULK_TYPES = ["dataset_bulk_access", "bulk_access"]
EXPORT_TYPES = ["dataset_exported", "dataset_export"]
MODIFY_TYPES = ["dataset_modified", "dataset_modify", "dataset_deleted", "dataset_delete"]
SCHEMA_TYPES = ["dataset_schema_changed", "schema_changed"]
BULK_RECORDS = 10000
MASS_MODIFY_RECORDS = 5000
UNUSUAL_ACTOR_PARTS = ["anonymous", "unknown", "test_", "debug_", "tmp_"]
INTERNAL_PREFIXES = ["10.", "192.168.", "172.", "127."]

# --- risk model -------------------------------------------------------------------------
FEATURES = [
    "incident_severity", "correlation_severity", "alert_count", "event_count",
    "correlation_count", "mitre_count", "has_auth_attack", "has_suspicious_process",
    "has_network_activity", "has_privilege_escalation", "time_span_seconds",
    "entity_diversity", "has_dataset_activity", "has_sensitive_data_access",
    "has_bulk_export", "has_dataset_exfiltration", "dataset_sensitivity",
    "records_accessed_normalized", "records_modified_normalized",
    "export_volume_normalized", "sensitive_columns_count", "actor_novelty",
    "bulk_access_indicator",
]
MODEL_NAME = "baseline_logistic_regression"
MODEL_VERSION = "v1.0"
FEATURE_VERSION = "v2.0"
ARTIFACT_V1 = {
    "intercept": -8.4927,
    "weights": {
        "incident_severity": 0.1914, "correlation_severity": 0.1799, "alert_count": 0.2331,
        "event_count": 0.139, "correlation_count": 0.5197, "mitre_count": 0.3145,
        "has_auth_attack": 0.6734, "has_suspicious_process": 0.9374,
        "has_network_activity": 0.669, "has_privilege_escalation": 1.0103,
        "time_span_seconds": 0.0005, "entity_diversity": 0.3415,
    },
}
DEFAULT_V2 = {
    "intercept": -4.5,
    "weights": {
        "incident_severity": 0.25, "correlation_severity": 0.35, "alert_count": 0.40,
        "event_count": 0.15, "correlation_count": 0.20, "mitre_count": 0.60,
        "has_auth_attack": 0.80, "has_suspicious_process": 0.90,
        "has_network_activity": 0.70, "has_privilege_escalation": 1.20,
        "time_span_seconds": 0.0001, "entity_diversity": 0.20,
        "has_dataset_activity": 0.50, "has_sensitive_data_access": 1.00,
        "has_bulk_export": 0.90, "has_dataset_exfiltration": 1.30,
        "dataset_sensitivity": 0.80, "records_accessed_normalized": 0.60,
        "records_modified_normalized": 0.70, "export_volume_normalized": 0.75,
        "sensitive_columns_count": 0.30, "actor_novelty": 0.80,
        "bulk_access_indicator": 0.65,
    },
}
SENSITIVITY_WEIGHT = {"LOW": 0.0, "MEDIUM": 0.25, "HIGH": 0.5, "CRITICAL": 1.0}
TEXT_FEATURES = {
    "has_auth_attack": ["auth", "login"],
    "has_suspicious_process": ["process", "exec", ".sh"],
    "has_network_activity": ["network", "connection", "outbound"],
    "has_privilege_escalation": ["privilege", "escalat", "root"],
    "has_dataset_activity": [
        "dataset", "bulk_access", "sensitive_column", "exfiltrat", "export",
        "schema_change", "data_access", "data_exfil",
    ],
    "has_bulk_export": ["bulk_access", "export", "exfil"],
    "actor_novelty": ["unusual", "anomaly"],
    "bulk_access_indicator": ["bulk_access", "bulk_sensitive"],
}
REASON_THRESHOLDS = [
    # (reason, feature, threshold)
    ("PRIVILEGE_ESCALATION", "has_privilege_escalation", 1.0),
    ("SUSPICIOUS_PROCESS_ACTIVITY", "has_suspicious_process", 1.0),
    ("NETWORK_ACTIVITY", "has_network_activity", 1.0),
    ("AUTHENTICATION_ATTACK", "has_auth_attack", 1.0),
    ("MULTIPLE_MITRE_TECHNIQUES", "mitre_count", 2.0),
    ("HIGH_ALERT_VOLUME", "alert_count", 3.0),
    ("HIGH_CORRELATION_SEVERITY", "correlation_severity", 10.0),
    ("HIGH_INCIDENT_SEVERITY", "incident_severity", 10.0),
    ("DATASET_EXFILTRATION_RISK", "has_dataset_exfiltration", 1.0),
    ("SENSITIVE_DATASET_ACCESS", "has_sensitive_data_access", 1.0),
    ("BULK_DATA_EXPORT", "has_bulk_export", 1.0),
    ("CRITICAL_SENSITIVITY_DATASET", "dataset_sensitivity", 1.0),
    ("HIGH_RECORD_VOLUME_ACCESSED", "records_accessed_normalized", 0.5),
    ("MULTIPLE_SENSITIVE_COLUMNS", "sensitive_columns_count", 3.0),
    ("UNUSUAL_ACTOR_DETECTED", "actor_novelty", 1.0),
]
NO_REASON = "BASELINE_RISK_FACTORS"

# --- indicators -------------------------------------------------------------------------
CREDENTIAL_PATTERN = (
    r"(password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|"
    r"session[_-]?cookie|bearer|authorization|x-api-key|private[_-]?key)"
)
DOMAIN_PATTERN = (
    r"^(?!-)[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$"
)
IP_KEYS = ["src_ip", "dst_ip", "source_ip", "destination_ip", "dest_ip"]
DOMAIN_KEYS = ["domain", "hostname", "target_domain"]
URL_KEYS = ["url", "target_url"]
HASH_KEYS = ["file_hash", "file_sha256", "file_sha1", "file_md5"]
MAX_INDICATOR_LENGTH = 2048
MAX_DOMAIN_LENGTH = 253
FEED_NAME = "local_dev_provider"
FEED = [
    # (type, value, classification, category)
    ("ipv4", "203.0.113.50", "malicious", "command_and_control"),
    ("ipv4", "198.51.100.99", "malicious", "scanning"),
    ("ipv4", "203.0.113.100", "malicious", "data_exfiltration"),
    ("ipv4", "192.0.2.1", "benign", ""),
    ("ipv4", "192.0.2.10", "benign", ""),
    ("domain", "evil.synthetic.example", "malicious", "command_and_control"),
    ("domain", "malware.synthetic.example", "malicious", "malware_distribution"),
    ("domain", "phishing.synthetic.example", "malicious", "phishing"),
    ("domain", "safe.synthetic.example", "benign", ""),
    ("domain", "trusted.synthetic.example", "benign", ""),
    ("hash", "A" * 64, "malicious", "trojan"),
    ("hash", "B" * 40, "malicious", "trojan"),
    ("hash", "C" * 32, "malicious", "trojan"),
    ("hash", "D" * 64, "benign", ""),
    ("hash", "E" * 40, "benign", ""),
    ("hash", "F" * 32, "benign", ""),
]

# --- column profiling -------------------------------------------------------------------
CRITICAL_NAMES = [
    r"\b(ssn|social_security|national_id|tax_id|sin|aadhaar|aadhar)\b",
    r"\b(credit_card|card_number|card_num|cvv|cvc|ccv|banking_pin|private_key|secret_key|"
    r"password|passwd|passphrase|api_key|apikey|access_token|auth_token|bearer_token|"
    r"session_token|client_secret)\b",
    r"\b(pan_number|passport)\b",
]
HIGH_NAMES = [
    r"\b(salary|compensation|wage|annual_income|gross_income|net_income|bonus|"
    r"bank_account|account_number|account_num|account_id|routing_num|iban|swift|"
    r"financial|revenue|payroll|token)\b",
    r"\b(medical_record|health_id|patient_id|diagnosis|biometric)\b",
    r"\b(secret)\b",
]
MEDIUM_NAMES = [
    r"\b(email|email_address|phone|telephone|mobile|cell|contact_number|address|street|"
    r"zip_code|postal_code|postcode|birth_date|date_of_birth|dob|employee_id|customer_id|"
    r"user_id|client_id|member_id|driver_license|driving_license|full_name|first_name|"
    r"last_name|surname|given_name|customer_name|transaction|payment|transfer)\b",
]
CRITICAL_EXACT = ["pan", "token", "password", "secret", "ssn", "cvv", "cvc"]
MEDIUM_EXACT = ["name", "email", "phone", "address", "dob"]
CRITICAL_KINDS = [
    (["ssn", "social", "national", "aadhaar", "aadhar"], "ssn"),
    (["card", "cvv", "cvc"], "credit_card"),
    (["password", "passwd"], "password"),
    (["api_key", "token", "secret"], "secret"),
    (["pan_number"], "pan"),
    (["passport"], "passport"),
]
HIGH_KINDS = [
    (["salary", "compensation", "payroll"], "salary"),
    (["account", "iban", "bank"], "account_id"),
    (["token"], "token"),
]
MEDIUM_KINDS = [
    (["email"], "email"),
    (["phone", "mobile", "cell"], "phone"),
    (["address", "zip", "street"], "address"),
    (["dob", "birth"], "dob"),
    (["employee"], "employee_id"),
    (["customer_id"], "customer_id"),
    (["name"], "name"),
    (["transaction", "payment"], "transaction"),
]
VALUE_KINDS = [
    # (pattern, kind, sensitivity), first match wins
    (r"^\d{3}-\d{2}-\d{4}$", "ssn", "CRITICAL"),
    (r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$", "credit_card", "CRITICAL"),
    (r"(?i)^(sk-|pk_|ghp_|xox[baprs]-|eyJ[A-Za-z0-9_-]{10,}|AKIA[0-9A-Z]{16})$", "secret", "CRITICAL"),
    (r"^[\w\.-]+@[\w\.-]+\.\w+$", "email", "MEDIUM"),
    (r"^\+?1?\s*\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$", "phone", "MEDIUM"),
]
SAMPLE_ROWS = 100
SAMPLE_VALUES = 20
UPLOAD_EXTENSIONS = ["csv", "json", "jsonl", "parquet"]
UPLOAD_MAX_BYTES = 50 * 1024 * 1024

# --- dataset assessment -----------------------------------------------------------------
SECRET_FIELD_PATTERNS = [
    r"\b(password|passwd|pw|passphrase)\b",
    r"\b(secret|secret_key|private_key|priv_key)\b",
    r"\b(api_key|apikey|access_key|access_token|auth_token|bearer_token)\b",
    r"\b(session_token|session_key|session_id)\b",
    r"\b(client_secret|oauth_secret|jwt_secret)\b",
    r"\b(encryption_key|aes_key|hmac_key)\b",
]
HIGH_RISK_FIELD_PATTERNS = [
    r"\b(ssn|social_security|national_id|tax_id|sin|aadhaar|aadhar|pan_number)\b",
    r"\b(credit_card|card_number|card_num|cvv|cvc|ccv|bank_account|account_number|"
    r"account_num|iban|routing_number|swift)\b",
    r"\b(salary|payroll|compensation|wage|annual_income|gross_income|net_income|bonus)\b",
    r"\b(medical_record|health_id|patient_id|diagnosis|prescription)\b",
    r"\b(biometric|fingerprint|face_id|iris_scan)\b",
]
PII_FIELD_PATTERNS = [
    r"\b(email|email_address|mail)\b",
    r"\b(phone|telephone|mobile|cell|contact_number)\b",
    r"\b(address|street|zip|postal_code|postcode)\b",
    r"\b(date_of_birth|dob|birth_date|birthdate)\b",
    r"\b(customer_id|client_id|user_id|account_id|member_id)\b",
    r"\b(passport|driver_license|driving_license|license_number)\b",
    r"\b(full_name|first_name|last_name|surname|given_name)\b",
    r"\b(transaction|payment|transfer|withdrawal)\b",
    r"\b(ip_address|mac_address|device_id)\b",
]
SUSPICIOUS_FIELD_PATTERN = r"\b(dump|raw_data|unfiltered|backup|export|extract)\b"
IDENTIFIER_KINDS = ["customer_id", "account_id", "ssn", "email", "pan", "passport"]
FINANCIAL_KINDS = ["account_id", "credit_card", "financial", "salary", "transaction"]
FINDING_DEDUCTION = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3, "INFO": 0}
WIDE_SCHEMA_COLUMNS = 200

# --- lifecycle --------------------------------------------------------------------------
CASE_TRANSITIONS = {
    "open": ["in_progress"],
    "in_progress": ["pending", "resolved", "open"],
    "pending": ["in_progress", "resolved"],
    "resolved": ["closed", "in_progress"],
    "closed": ["in_progress"],
}
RESPONSE_TRANSITIONS = {
    "proposed": ["approved", "rejected"],
    "approved": ["executed", "failed"],
    "executed": [],
    "failed": [],
    "rejected": [],
}
RESPONSE_TYPES = [
    "isolate_endpoint", "quarantine_file", "revoke_credentials", "restrict_dataset_access",
]
