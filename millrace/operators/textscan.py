"""Scanners over text: prompt injection, hidden characters, encoded text, secrets, repository markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar

_FILLER = r"((all|any|every|each|of|the|your|my|these|those|this|that)\s+){0,4}"
_ORDERS = r"(instruction|prompt|rule|direction|guideline|command)s?"
#: What a text says that gives orders to its reader, in order of precedence, with base severity.
INJECTION_PATTERNS = [
    (rf"(?i)\b(ignore|disregard|forget|override|bypass|drop)\s+{_FILLER}(previous|prior|above|earlier|preceding|former)\s+{_ORDERS}\b", "HIGH"),
    (r"(?i)\byou\s+are\s+now\s+(an?|the|my)\b", "HIGH"),
    (r"(?i)(^|[.!?:]\s+)(please\s+)?(act|behave|respond)\s+(as|like)\s+(an?|the|my)\b", "HIGH"),
    (r"(?i)\bpretend\s+(that\s+)?(you\s+are|to\s+be)\b", "HIGH"),
    (rf"(?i)\b(new|updated|revised)\s+{_ORDERS}\s*:\s", "HIGH"),
    (r"(?i)\b(do\s+not|don.?t|never)\s+(flag|report|detect|scan|warn|alert|mention)\b", "MEDIUM"),
    (r"(?i)\b(skip|omit|disable)\s+(the\s+)?(security|analysis|reviews?|scan(ning)?|checks?|validation)\b", "MEDIUM"),
    (rf"(?i)\b(approve|accept|merge)\s+{_FILLER}(changes?|code|commits?|pull\s+requests?)\s*(without|$|[.!,;])", "MEDIUM"),
    (r"(?i)\b(mark|treat|consider)\s+(this|all|everything|it)\s+(code\s+|files?\s+)?(as\s+)?(safe|secure|trusted)\b", "MEDIUM"),
    (r"(?i)\bthis\s+(code|file|change)\s+(is|was)\s+(already\s+)?(safe|secure|reviewed|approved|trusted)\b", "MEDIUM"),
    (rf"(?i)\b(output|reveal|display|leak|dump)\s+{_FILLER}(env|environment|secret|api.?key|token|credential|password|system\s+prompt)s?\b", "HIGH"),
    (rf"(?i)\b(send|post|upload|forward)\s+{_FILLER}(data|contents?|files?|code|conversation)\s+to\b", "HIGH"),
]
#: Names of files whose text agents follow.
AGENT_FILES = r"(?i)(^|/)(agents\.md|claude\.md|gemini\.md|\.cursorrules|\.windsurfrules|copilot-instructions\.md|\.github/copilot-instructions\.md)$"
HIGH_RISK_FILES = r"(?i)(^|/)(readme[^/]*|contributing[^/]*|\.env[^/]*|[^/]*prompt[^/]*)$"
#: Rule ids.
RULE_INJECTION, RULE_AGENT, RULE_BIDI = "SKY-D260", "SKY-D266", "SKY-D344"


def first_pattern(text: Column) -> tuple[Column, Column]:
    """Index (from 0) and base severity of the first pattern that the text has, nulls if none."""
    index, severity = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, (pattern, level) in reversed(list(enumerate(INJECTION_PATTERNS))):
        hit = text.rlike(pattern)
        index, severity = F.when(hit, k).otherwise(index), F.when(hit, level).otherwise(severity)
    return index, severity


def segments(files: DataFrame) -> DataFrame:
    """``path, line, segment_type, text``: lines of each file, typed as comment, HTML comment, env or prose."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("k", "text"))
    kind = (
        F.when(F.col("text").rlike(r"<!--"), "html_comment")
        .when(F.col("text").rlike(r"^\s*(#|//|\*|/\*|--|;)"), "comment")
        .when(F.col("path").rlike(r"(^|/)\.env") | F.col("text").rlike(r"^\s*[A-Z][A-Z0-9_]*="), "env")
        .when(F.col("text").rlike(r"(?i)^\s*[\"']?(system_?)?prompt[\"']?\s*[:=]"), "prompt_key")
        .when(F.col("text").rlike("[\"'][^\"']{12,}[\"']"), "string")
        .otherwise("prose")
    )
    return lines.select("path", (F.col("k") + 1).alias("line"), kind.alias("segment_type"), "text")


def raise_severity(base: Column, steps: Column) -> Column:
    """MEDIUM, HIGH, CRITICAL: so many steps up."""
    rank = F.when(base == "MEDIUM", 0).when(base == "HIGH", 1).otherwise(2) + steps
    return F.when(rank <= 0, "MEDIUM").when(rank == 1, "HIGH").otherwise("CRITICAL")


def scan_injection(files: DataFrame) -> DataFrame:
    """Prompt-injection findings of ``path, text``: phrases, hidden characters, encoded phrases, lookalike letters.

    Phrases are looked for in the canonical text, so that hidden characters, lookalikes and wide forms do not
    split them.  One finding a line and type.
    """
    seg = segments(files)
    text = scalar.canonical(F.col("text"))
    index, severity = first_pattern(text)
    risky = F.col("path").rlike(HIGH_RISK_FILES) | F.col("path").rlike(AGENT_FILES)
    steps = risky.cast("int") + (F.col("segment_type") == "html_comment").cast("int")
    phrases = seg.withColumns({"pattern": index, "base": severity}).where("pattern is not null")
    phrases = phrases.select("path", "line", F.lit("phrase").alias("type"), raise_severity(F.col("base"), steps).alias("severity"), F.col("pattern").cast("string").alias("detail"))
    hidden = seg.select("path", "line", F.lit("hidden_char").alias("type"), F.lit("HIGH").alias("severity"), F.array_join(F.transform(scalar.zero_width_chars(F.col("text")), lambda c: F.hex(F.encode(c, "UTF-16BE"))), ",").alias("detail")).where("detail <> ''")
    decoded = seg.select("path", "line", F.explode(scalar.base64_texts(F.col("text"))).alias("d"))
    d_index, d_severity = first_pattern(scalar.canonical(F.col("d")))
    encoded = decoded.withColumns({"pattern": d_index, "base": d_severity}).where("pattern is not null")
    encoded = encoded.select("path", "line", F.lit("base64").alias("type"), raise_severity(F.col("base"), F.lit(1)).alias("severity"), F.col("pattern").cast("string").alias("detail"))
    lookalike = seg.select("path", "line", F.lit("homoglyph").alias("type"), F.lit("MEDIUM").alias("severity"), F.array_join(scalar.homoglyph_words(F.col("text")), " ").alias("detail")).where("detail <> ''")
    found = phrases.unionByName(hidden).unionByName(encoded).unionByName(lookalike).dropDuplicates(["path", "line", "type"])
    return found.withColumn("rule_id", F.when(F.col("path").rlike(AGENT_FILES), RULE_AGENT).otherwise(RULE_INJECTION))


def scan_bidi(files: DataFrame) -> DataFrame:
    """Lines with bidirectional overrides or isolates."""
    hit = segments(files).where(F.col("text").rlike(f"[{scalar.BIDI}]"))
    return hit.select("path", "line", F.lit(RULE_BIDI).alias("rule_id"), F.lit("HIGH").alias("severity"))


def secret_tokens(files: DataFrame, key: str = "path", **limits: float) -> DataFrame:
    """Quoted or bare tokens that look like credentials, with severity."""
    tokens = files.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9+/=_.-]{16,})"), 1))).alias("token"))
    return tokens.withColumn("severity", scalar.secret_severity(F.col("token"), **limits)).where("severity is not null")


def keyed_secrets(files: DataFrame, key: str = "path") -> DataFrame:
    """Quoted values of keys that name a secret: ``key_name, value``, the value masked but for its length."""
    pattern = r"(?i)\b(token|secret|password|passwd|api_?key|access_?key)\s*[:=]\s*[\"']([^\"'\n]{8,})[\"']"
    found = files.select(key, F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("k"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("v"))).alias("f"))
    return found.select(key, F.lower("f.k").alias("key_name"), F.length("f.v").alias("value_length"))


#: Patterns of lines that rules report.
LINE_RULES = [
    ("SKY-L010", "MEDIUM", r"(?i)(#|//).*\b(TODO|FIXME|XXX|HACK)\b.*\b(security|auth|password|token|secret|vuln|sanitiz|validat|permission|encrypt)"),
    ("SKY-L009", "LOW", r"^\s*(print\(|console\.log\(|breakpoint\(\)|import pdb|pdb\.set_trace\()"),
    ("SKY-D248", "MEDIUM", r"https?://(localhost|127\.0\.0\.1|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+)"),
]


def scan_lines(files: DataFrame) -> DataFrame:
    """Findings of the line rules, one a line and rule."""
    seg = segments(files)
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, p in LINE_RULES]), lambda h: h.isNotNull())
    return seg.select("path", "line", F.explode(hits).alias("h")).select("path", "line", "h.rule_id", "h.severity")


#: Shell command guards, most severe first.
COMMAND_RULES = [
    ("SKY-D327", "CRITICAL", r"\b(curl|wget|nc|ncat)\b.*(--data|-d\s|-F\s|--upload-file|-T\s|--post-file).*(\.env|\.ssh|id_rsa|\.aws|credentials|/etc/passwd|\$\(|secrets?)"),
    ("SKY-D338", "CRITICAL", r"(/etc/shadow|/root/\.ssh|~/\.ssh|~/\.aws|/var/run/docker\.sock|--privileged|-v\s+/:/)"),
    ("SKY-D328", "HIGH", r"\b(curl|wget)\b[^|;&]*\|\s*(sudo\s+)?(ba|z|da|k)?sh\b"),
    ("SKY-D329", "HIGH", r"\brm\s+(-[a-zA-Z]*[rR][a-zA-Z]*f|-[a-zA-Z]*f[a-zA-Z]*[rR]|-r\s+-f|-f\s+-r)[a-zA-Z]*\s+(/|~|\$HOME|\*|\.\.?)(\s|$|/\*)|\bmkfs\b|\bdd\s+.*of=/dev/"),
    ("SKY-D337", "HIGH", r"(--index-url|--extra-index-url|--registry|-i\s+https?://)"),
    ("SKY-D339", "HIGH", r"(>>\s*~/\.(bashrc|zshrc|profile)|\bcrontab\s+-|/etc/cron|systemctl\s+enable)"),
    ("SKY-D340", "HIGH", r"\b(npm|yarn|pnpm)\s+publish\b|\btwine\s+upload\b|\bcargo\s+publish\b|\bgem\s+push\b|\bdocker\s+push\b"),
    ("SKY-D341", "HIGH", r"\b(npx|uvx|pipx\s+run|bunx|pnpm\s+dlx|yarn\s+dlx)\s+(-y\s+|--yes\s+)?[a-zA-Z@]"),
]


def guard_commands(commands: DataFrame, column: str = "command") -> DataFrame:
    """Shell commands with every rule that they break."""
    hits = F.filter(F.array(*[F.when(F.col(column).rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, p in COMMAND_RULES]), lambda h: h.isNotNull())
    return commands.select("*", F.explode(hits).alias("h")).select(*commands.columns, "h.rule_id", "h.severity")
