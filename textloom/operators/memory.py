"""What to remember of conversations: durable sentences, where they belong, and whether they may be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of secrets, passing remarks and durable facts, and of each kind of memory.
SECRETS = (
    r"(?i)\b(password|passwd|pwd)\s*[:=]\s*\S+",
    r"(?i)\b(api[_-]?key|apikey)\s*[:=]\s*\S+",
    r"(?i)\b(secret|token|bearer)\s*[:=]\s*\S+",
    r"(?i)\b(sk-[a-zA-Z0-9]{10,})\b",
    r"(?i)\b(ghp_[a-zA-Z0-9]{20,})\b",
    r"(?i)\b(eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,})\b",
    r"(?i)\b(-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----)",
    r"(?i)\b(credit\s*card|cvv|cvc)\s*[:=]?\s*\d",
    r"(?i)\b(ssn|social security)\s*[:=]?\s*\d",
)
EPHEMERAL = ("i'm tired", "i am tired", "feeling sad", "just kidding", "never mind", "nvm")
DURABLE = (
    r"(?i)(user prefers? .{5,120}|prefers? (beginner|detailed|concise).{0,80})",
    r"(?i)(building|working on|creating) (a |an )?.{5,80}",
    r"(?i)(wants?|needs?) .{0,40}(examples?|fastapi|postgres|react)",
    r"(?i)(for project .{3,60},? (the )?(chosen|using|db is) .{3,80})",
    r"(?i)(current plan|next step|working on task)[:.]? .{5,120}",
)
MARKERS = ("prefer", "building", "project", "chosen", "using", "goal", "always", "instruction", "postgres", "fastapi")
ROUTES = (
    ("session", "task_state", 0.7, (r"(?i)\b(current(ly)?|working on|in progress|next step|todo|task)\b", r"(?i)\b(plan|step \d+|unfinished|pending)\b")),
    ("project", "decision", 0.82, (r"(?i)\b(chosen|selected|using|decided|architecture|stack)\b", r"(?i)\b(postgres|postgresql|mysql|mongodb|redis|fastapi|django)\b")),
    ("agent", "instruction", 0.78, (r"(?i)\b(always|never|must|should always|tool preference)\b",)),
    ("episodic", "event", 0.75, (r"(?i)\b(completed|finished|started|changed|corrected|onboarding)\b",)),
    ("user", "preference", 0.85, (r"(?i)\b(prefer|likes?|wants?|always use|please use)\b", r"(?i)\b(beginner.friendly|detailed|concise|examples?)\b")),
)
OTHERWISE = ("user", "fact", 0.72)
LONG_TERM = ("preference", "fact", "goal", "skill_level", "instruction", "warning", "decision", "project_context")


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def is_ephemeral(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for phrase in EPHEMERAL:
        out = out | F.contains(low, F.lit(phrase))
    return out


def extracted(turns: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, position, content): the sentences of each turn that are worth keeping, equal ones once by case-blind text.

    Sentences end at a terminal mark and white space or at a line's end; of at least 12 characters, no secret, no passing
    remark, and with a sign of lasting use.
    """
    parts = F.split(F.col(text), r"(?<=[.!?])\s+|\n+")
    made = turns.select(*keys, F.posexplode(parts).alias("position", "part")).select(*keys, "position", F.btrim("part", F.lit(" \t\n\r\x0b\x0c")).alias("content"))
    c = F.col("content")
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(F.lower(c), F.lit(m))
    kept = made.where((F.length(c) >= 12) & ~matches(c, SECRETS) & ~is_ephemeral(c) & (marked | matches(c, DURABLE)))
    first = Window.partitionBy(*keys, F.lower(c)).orderBy("position")
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def routed(content: Column) -> Column:
    """struct<level, type, confidence>: of the first kind of memory whose pattern is found."""
    of = lambda level, kind, sure: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    out = of(*OTHERWISE)
    for level, kind, sure, patterns in reversed(ROUTES):
        out = F.when(matches(content, patterns), of(level, kind, sure)).otherwise(out)
    return out


def policy(content: Column, level: Column, kind: Column, confidence: Column, privacy: Column, least: float) -> Column:
    """struct<allowed, reason, confidence>: the first rule that forbids storing, or the confidence to store with."""
    reason = (
        F.when(privacy == "do_not_store", "privacy_do_not_store")
        .when(matches(content, SECRETS), "secret_detected")
        .when(is_ephemeral(content) & (level != "session"), "ephemeral_statement")
        .when((level == "user") & ~kind.isin(*LONG_TERM), "invalid_user_memory_type")
        .when((confidence < least) & level.isin("user", "agent", "project"), "confidence_below_threshold")
    )
    sure = F.when((privacy == "sensitive") & (level == "user"), F.least(confidence, F.lit(0.75))).otherwise(confidence)
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"), F.when(reason.isNull(), sure).alias("confidence"))


# Words that turn a statement round.
NEGATIONS = ("not ", "no longer ", "don't ", "do not ")


def contradicts(a: Column, b: Column) -> Column:
    """Whether one text holds a negation and, but for it, the other text."""
    a, b, out = F.lower(a), F.lower(b), F.lit(False)
    for n in NEGATIONS:
        plain = lambda c: F.replace(c, F.lit(n), F.lit(""))  # noqa: B023, E731
        out = out | (F.contains(a, F.lit(n)) & F.contains(a, plain(b))) | (F.contains(b, F.lit(n)) & F.contains(b, plain(a)))
    return out


def without_contradicted(items: DataFrame, kind: list[str], recency: str, content: str = "content") -> DataFrame:
    """Drops the items that the newest of their kind contradicts."""
    newest = items.groupBy(*kind).agg(F.max_by(F.col(content), F.col(recency)).alias("_won"), F.max(recency).alias("_top"))
    joined = items.join(newest, kind)
    return joined.where((F.col(recency) == F.col("_top")) | ~contradicts(F.col("_won"), F.col(content))).drop("_won", "_top")
