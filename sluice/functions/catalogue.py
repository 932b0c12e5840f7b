"""Categories, actions, the pattern catalogue and label maps."""

from __future__ import annotations

from dataclasses import dataclass

# Names, patterns, confidences and label maps that results depend on.
ACTIONS = ("BLOCK", "MASK", "TOKENIZE", "ALLOW")

CATEGORIES = (
    "private_key", "cloud_api_key", "database_url", "jwt", "email", "domain", "internal_ip", "customer_name",
    "private_name", "private_phone", "private_address", "account_number", "secret", "other",
)


@dataclass(frozen=True)
class Pattern:
    """regex: Java syntax under (?U) and (?d), so that classes and boundaries are Unicode and `.` stops at line feeds
    only. re2: the same for DuckDB, where it must be spelled otherwise. anchors: a text without any of these literals
    cannot match (in lower case, if the pattern heeds no case). gate: neither can one without a match of this."""

    name: str
    category: str
    regex: str
    confidence: float
    anchors: tuple[str, ...] = ()
    gate: str | None = None
    re2: str | None = None

    @property
    def java(self) -> str:
        return f"(?Ud){self.regex}"

    @property
    def sql(self) -> str:
        return self.re2 or self.regex

    @property
    def detector(self) -> str:
        return f"regex:{self.name}"


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_ZONES = "com|net|org|io|ai|co|dev|app|cloud|tech|info|us|uk|de|fr|local|internal|corp"
_DB_TAIL = r"@[^\s/]+(?:/[^\s]*)?"

PATTERNS = (
    Pattern("pem_private_key", "private_key", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP |ENCRYPTED |PRIVATE |PRIV )?PRIVATE KEY( BLOCK)?-----", 0.99, ("-----BEGIN ",)),
    Pattern("aws_access_key_id", "cloud_api_key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", 0.95, ("AKIA", "ASIA")),
    Pattern("aws_secret_access_key", "cloud_api_key", r"""(?i)\baws(.{0,20})?(?:secret|key)(.{0,20})?["'=:\s]+([A-Za-z0-9/+=]{40})\b""", 0.70, ("aws",)),
    Pattern("gcp_service_account_json", "cloud_api_key", r'(?s)"type"\s*:\s*"service_account".{0,500}?"private_key"\s*:', 0.97, ('"service_account"',)),
    Pattern("gcp_api_key", "cloud_api_key", r"\b(AIza[0-9A-Za-z_\-]{35})\b", 0.90, ("AIza",)),
    Pattern("azure_storage_connection_string", "cloud_api_key", r"DefaultEndpointsProtocol=https?;AccountName=[A-Za-z0-9]+;AccountKey=[A-Za-z0-9+/=]{40,};(?:EndpointSuffix=[^;\s]+)?", 0.97, ("DefaultEndpointsProtocol=",)),
    Pattern("azure_ad_client_secret", "cloud_api_key", r"\b([A-Za-z0-9_~.\-]{3}[Q~][A-Za-z0-9_~.\-]{31,34})\b", 0.55, ("Q", "~")),
    Pattern("postgres_url", "database_url", rf"\b(postgres(?:ql)?)://[^\s:@/]+:[^\s:@/]+{_DB_TAIL}", 0.97, ("postgres",)),
    Pattern("mysql_url", "database_url", rf"\bmysql://[^\s:@/]+:[^\s:@/]+{_DB_TAIL}", 0.97, ("mysql://",)),
    Pattern("mongodb_url", "database_url", rf"\bmongodb(?:\+srv)?://[^\s:@/]+:[^\s:@/]+{_DB_TAIL}", 0.97, ("mongodb",)),
    Pattern("redis_url", "database_url", rf"\brediss?://(?:[^\s:@/]*:)?[^\s:@/]+{_DB_TAIL}", 0.95, ("redis",)),
    Pattern("jwt", "jwt", r"\b(eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})\b", 0.95, ("eyJ",)),
    Pattern("rfc1918_ipv4", "internal_ip", rf"\b(?:10\.{_OCTET}\.{_OCTET}\.{_OCTET}|172\.(?:1[6-9]|2\d|3[01])\.{_OCTET}\.{_OCTET}|192\.168\.{_OCTET}\.{_OCTET})\b", 0.99, ("10.", "172.", "192.168.")),
    Pattern("email", "email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.90, ("@",)),
    Pattern("domain", "domain", rf"(?i)\b(?:[a-z0-9](?:[a-z0-9\-]{{0,61}}[a-z0-9])?\.)+(?:{_ZONES})\b", 0.70, gate=rf"(?iu)\.(?:{_ZONES})"),
    Pattern("slack_token", "secret", r"\b(xox[baprs]-[A-Za-z0-9\-]{10,})\b", 0.97, ("xox",)),
    Pattern("github_pat", "secret", r"\b(ghp_[A-Za-z0-9]{36,})\b", 0.99, ("ghp_",)),
    Pattern("github_fine_grained_pat", "secret", r"\b(github_pat_[A-Za-z0-9_]{82,})\b", 0.99, ("github_pat_",)),
)

_ANY_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"

BASELINE = (
    Pattern("v0_email", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.70, ("@",)),
    Pattern("v0_ipv4", "internal_ip", rf"\b(?:{_ANY_OCTET}\.){{3}}{_ANY_OCTET}\b", 0.70, (".",)),
    Pattern("v0_aws_key", "cloud_api_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0.70, ("AKIA", "ASIA")),
    Pattern("v0_hex", "secret", r"\b[A-Fa-f0-9]{32,}\b", 0.70),
)

PRIVACY_MODEL_LABELS = {
    "account_number": "account_number", "private_address": "private_address", "private_email": "email",
    "private_name": "private_name", "private_person": "private_name", "private_phone": "private_phone",
    "secret": "secret", "private_date": "other", "private_url": "domain", "private_id": "other", "background": "other",
}

ENTITY_LABELS = {
    "EMAIL_ADDRESS": "email", "PHONE_NUMBER": "private_phone", "PERSON": "private_name", "LOCATION": "private_address",
    "IP_ADDRESS": "internal_ip", "URL": "domain", "CREDIT_CARD": "account_number", "IBAN_CODE": "account_number",
    "US_BANK_NUMBER": "account_number", "US_SSN": "account_number", "CUSTOMER_NAME": "customer_name",
}

CORPUS_LABELS = {
    "EMAIL": "email", "IP": "internal_ip", "GIVENNAME1": "private_name", "GIVENNAME2": "private_name",
    "LASTNAME1": "private_name", "LASTNAME2": "private_name", "LASTNAME3": "private_name", "TEL": "private_phone",
    "STREET": "private_address", "BUILDING": "private_address", "CITY": "private_address", "POSTCODE": "private_address",
    "STATE": "private_address", "COUNTRY": "private_address", "SECADDRESS": "private_address",
}

CORPUS_EXCLUDED = (
    "USERNAME", "IDCARD", "SOCIALNUMBER", "PASSPORT", "DRIVERLICENSE", "BOD", "DATE", "TIME", "SEX", "TITLE", "PASS",
    "GEOCOORD", "CARDISSUER",
)

PRIVATE_PREFIX = r"^(?:10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.)"

TOKEN = r"\[[A-Z][A-Z_]*_[a-f0-9]{16,}\]"
# End of fixed values.
