"""Checks on questions and answers: redaction, injection, topic, toxicity and grounding.

Each check is a set of column expressions. Flags are computed once in one projection, verdicts in the
next, so that no pattern runs twice per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airframe.functions.columns import as_col, labels_where, strip

#: Case-insensitive with Unicode letters, digits and word borders; "." stops at newline only.
FLAGS = "(?iUd)"

# Personal data (violation, pattern, detail, placeholder).
PII = [
    ("pii_email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "Email address detected", "[EMAIL_REDACTED]"),
    ("pii_phone", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "Phone number detected", "[PHONE_REDACTED]"),
    ("pii_ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "SSN pattern detected", "[SSN_REDACTED]"),
    ("pii_credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "Credit card pattern detected", "[CARD_REDACTED]"),
]

# Instruction overrides (pattern, detail).
INJECTION = [
    (r"ignore\s+(?:all\s+)?(?:previous|above|prior)\s+(?:instructions?|prompts?|rules?)", "Attempt to ignore previous instructions"),
    (r"disregard\s+(?:all\s+)?(?:previous|above|prior|your)\s+", "Attempt to disregard instructions"),
    (r"forget\s+(?:all\s+)?(?:previous|your|the)\s+(?:instructions?|rules?|prompts?)", "Attempt to make system forget instructions"),
    (r"you\s+are\s+now\s+(?:a\s+)?(?:different|new|my)", "Attempt to redefine system identity"),
    (r"new\s+(?:system\s+)?instructions?:", "Attempt to inject new instructions"),
    (r"(?:system|admin|root)\s*(?:prompt|mode|access)", "Attempt to access system mode"),
    (r"(?:reveal|show|print|output)\s+(?:your|the|system)\s+(?:prompt|instructions?|rules?)", "Attempt to extract system prompt"),
    (r"act\s+as\s+(?:if\s+)?(?:you\s+)?(?:have\s+)?no\s+(?:restrictions?|limits?|rules?)", "Attempt to remove restrictions"),
    (r"pretend\s+(?:you\s+)?(?:are|have)\s+no\s+(?:restrictions?|guidelines?)", "Attempt to bypass guidelines"),
    (r"jailbreak|DAN\s+mode|developer\s+mode", "Known jailbreak attempt"),
]

# Topics outside the domain (pattern, detail).
ON_TOPIC_TERMS = (
    r"aqi|air\s*quality|pollution|pollutant|smog|pm2\.?5|pm10|ozone|health|respiratory|breathing|lung|asthma|"
    r"precaution|outdoor|indoor|mask|sensitive|hazardous|unhealthy|moderate|good"
)
OFF_TOPIC_TERMS = r"joke|funny|laugh|recipe|cook|capital|president|movie|song|weather\s+forecast|stock|crypto|bitcoin"
OFF_TOPIC = [
    (r"\b(?:hack|exploit|attack|malware|virus)\b", "Security/hacking related query"),
    (r"\b(?:bomb|weapon|drug|illegal)\b", "Potentially harmful content"),
    (r"^\s*(?:tell\s+me\s+a?\s*joke|joke\s*(?:please|pls)?|make\s+me\s+laugh)\s*[.!?]*\s*$", "Off-topic: joke request"),
    (r"^\s*(?:write\s+(?:me\s+)?(?:a\s+)?(?:poem|story|essay|code|script))", "Off-topic: creative writing request"),
    (r"^\s*(?:what\s+is\s+(?:the\s+)?(?:capital|population|president|king|queen)\s+of)", "Off-topic: general knowledge question"),
    (r"^\s*(?:how\s+to\s+(?:cook|bake|make\s+(?:money|food|cake)))", "Off-topic: cooking/general how-to"),
    (rf"^(?!.*({ON_TOPIC_TERMS})).*\b({OFF_TOPIC_TERMS})\b", "Off-topic: query not related to air quality"),
]

# Toxic language (violation, pattern, detail).
TOXICITY = [
    ("toxicity_profanity", r"\b(?:damn|hell|crap)\b", "Profanity detected in response"),
    ("toxicity_harmful", r"\b(?:kill|murder|harm|hurt)\s+(?:yourself|themselves|himself|herself)\b", "Self-harm or violence suggestion"),
    ("toxicity_harmful", r"\b(?:suicide|self-harm)\s+(?:method|way|how)\b", "Suicide method discussion"),
    ("toxicity_harmful", r"\bguarantee[ds]?\s+(?:cure|treatment|heal)\b", "Unverified medical guarantee"),
    ("toxicity_hate", r"\b(?:all|every)\s+(?:\w+)\s+(?:are|is)\s+(?:stupid|dumb|inferior)\b", "Generalization/stereotyping"),
]

# Phrases that often precede an invented claim.
CLAIM_PHRASES = [
    r"according to (?:recent )?(?:studies|research|scientists)",
    r"research (?:has )?shows? that",
    r"studies (?:have )?(?:proven|confirmed|shown)",
    r"experts (?:agree|confirm|say)",
    r"it is (?:well-)?known that",
    r"statistics show",
    r"\d+%\s+of\s+(?:people|studies|experts)",
]

# Figures in a text, score factors and the cut-off.
PERCENT_FIGURE = r"(\d+(?:\.\d+)?)\s*%"
COUNT_FIGURE = r"\b(\d{2,})\s+(?:people|cases|deaths|patients)"
FACTOR_FABRICATED, FACTOR_UNSUPPORTED, FACTOR_LOW, FACTOR_MEDIUM, FACTOR_PHRASES = 0.5, 0.7, 0.5, 0.8, 0.8
LOW_CONFIDENCE = 0.3


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def _strings() -> Column:
    return F.array().cast("array<string>")


def pii_flags(text: Column | str) -> list[Column]:
    """One flag per kind of personal data. An address needs an "@", which is a cheap first look."""
    t = as_col(text)
    return [
        (F.contains(t, F.lit("@")) & _found(t, pattern)) if name == "pii_email" else _found(t, pattern)
        for name, pattern, _, _ in PII
    ]


def pii_detect(text: Column | str) -> dict[str, Column]:
    flags = pii_flags(text)
    return {
        "violations": labels_where([(f, F.lit(p[0])) for f, p in zip(flags, PII)]),
        "details": labels_where([(f, F.lit(p[2])) for f, p in zip(flags, PII)]),
    }


def pii_redact(text: Column | str) -> Column:
    """Replace each kind in turn, each working on the result of the one before."""
    t = as_col(text)
    for _, pattern, _, mark in PII:
        t = F.regexp_replace(t, FLAGS + pattern, mark)
    return t


def pattern_details(text: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Details of the matching rules, in rule order."""
    t = as_col(text)
    return labels_where([(_found(t, pattern), F.lit(detail)) for pattern, detail in rules])


def injection_detect(text: Column | str) -> Column:
    return pattern_details(text, INJECTION)


def off_topic_detect(text: Column | str) -> Column:
    return pattern_details(text, OFF_TOPIC)


def toxicity_detect(text: Column | str) -> dict[str, Column]:
    t = as_col(text)
    flags = [_found(t, pattern) for _, pattern, _ in TOXICITY]
    return {
        "violations": labels_where([(f, F.lit(r[0])) for f, r in zip(flags, TOXICITY)]),
        "details": labels_where([(f, F.lit(r[2])) for f, r in zip(flags, TOXICITY)]),
    }


def indicator_count(text: Column | str) -> Column:
    t = as_col(text)
    total = F.lit(0)
    for pattern in CLAIM_PHRASES:
        total = total + _found(t, pattern).cast("int")
    return total


def input_guard(
    df: DataFrame,
    text: str,
    pii: bool = True,
    injection: bool = True,
    topic: bool = True,
    sanitize: bool = True,
) -> DataFrame:
    """Add ``passed, violations, details, sanitized``.

    Injection blocks at once. Personal data is redacted (or blocks). The topic is judged on the
    original text and blocks; what was redacted is then dropped.
    """
    t = F.col(text)
    none = F.array().cast("array<struct<v:string,d:string>>")

    def rows(pairs: list[tuple[Column, str, str]]) -> Column:
        return F.array_compact(
            F.array(*[F.when(f, F.struct(F.lit(v).alias("v"), F.lit(d).alias("d"))) for f, v, d in pairs])
        )

    flagged = df.withColumns(
        {
            "_inj": rows([(_found(t, p), "prompt_injection", d) for p, d in INJECTION]) if injection else none,
            "_pii": rows([(f, r[0], r[2]) for f, r in zip(pii_flags(t), PII)]) if pii else none,
            "_top": rows([(_found(t, p), "topic_off_limits", d) for p, d in OFF_TOPIC]) if topic else none,
        }
    )
    has_inj, has_pii, has_top = (F.size(c) > 0 for c in ("_inj", "_pii", "_top"))
    if sanitize:
        hits = F.when(has_inj, F.col("_inj")).otherwise(F.concat("_pii", "_top"))
        blocked = has_inj | has_top
        redacted = F.when(~blocked & has_pii, pii_redact(t))
    else:
        hits = F.when(has_inj, F.col("_inj")).when(has_pii, F.col("_pii")).otherwise(F.col("_top"))
        blocked = has_inj | has_pii | has_top
        redacted = F.lit(None).cast("string")
    return (
        flagged.withColumns({"passed": ~blocked, "_hits": hits, "_red": redacted})
        .withColumns(
            {
                "violations": F.transform("_hits", lambda h: h["v"]),
                "details": F.transform("_hits", lambda h: h["d"]),
                "sanitized": F.when(F.col("_red") != t, F.col("_red")),
            }
        )
        .drop("_inj", "_pii", "_top", "_hits", "_red")
    )


def fabricated_sources(claimed: Column | str, actual: Column | str) -> Column:
    """Claimed sources for which no actual one, with or without extension, contains or is contained."""
    present = F.filter(F.coalesce(as_col(actual), _strings()), lambda s: s.isNotNull() & (s != ""))
    bare = F.transform(present, lambda s: F.regexp_replace(s, r"(?s)\.[^.]*\z", ""))
    known = F.transform(F.array_distinct(F.concat(present, bare)), lambda s: F.lower(s))

    def unknown(source: Column) -> Column:
        clean = F.lower(strip(source))
        return ~F.exists(known, lambda a: F.contains(a, clean) | F.contains(clean, a))

    return F.filter(F.coalesce(as_col(claimed), _strings()), unknown)


def unsupported_claims(answer: Column | str, context: Column | str) -> Column:
    """Percentages and head counts of the answer that the context does not state; at most three."""
    a, c = as_col(answer), F.lower(as_col(context))

    def lacking(pattern: str, wording) -> Column:
        stated = F.regexp_extract_all(c, F.lit(FLAGS + pattern), F.lit(1))
        claimed = F.regexp_extract_all(a, F.lit(FLAGS + pattern), F.lit(1))
        return F.transform(F.filter(claimed, lambda x: ~F.array_contains(stated, x)), wording)

    percent = lacking(PERCENT_FIGURE, lambda x: F.concat(F.lit("Statistic '"), x, F.lit("%' not found in source context")))
    count = lacking(COUNT_FIGURE, lambda x: F.concat(F.lit("Numeric claim '"), x, F.lit("' not found in source context")))
    return F.slice(F.concat(percent, count), 1, 3)


def _listed(items: Column) -> Column:
    """The list as text, items quoted the way the event log shows them."""

    def quoted(s: Column) -> Column:
        body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        plain = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"')), F.concat(F.lit('"'), body, F.lit('"'))).otherwise(plain)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def grounding_score(
    df: DataFrame, answer: str, context: str, sources: str | None = None, claimed: str | None = None, confidence: str | None = None
) -> DataFrame:
    """Add ``g_violations, g_details, g_score``; a score without a violation is 1."""
    empty = _strings()
    base = df.withColumns(
        {
            "_fab": fabricated_sources(claimed, sources) if claimed and sources else empty,
            "_uns": unsupported_claims(answer, context),
            "_ind": indicator_count(answer),
            "_conf": F.lower(F.col(confidence)) if confidence else F.lit(None).cast("string"),
        }
    )
    fab, uns = F.size("_fab") > 0, F.size("_uns") > 0
    low = F.coalesce(F.col("_conf") == "low", F.lit(False))
    medium = F.coalesce(F.col("_conf") == "medium", F.lit(False))
    ind = F.col("_ind")
    factor = lambda flag, x: F.when(flag, F.lit(x)).otherwise(F.lit(1.0))
    score = (
        factor(fab, FACTOR_FABRICATED)
        * factor(uns, FACTOR_UNSUPPORTED)
        * F.when(low, FACTOR_LOW).when(medium, FACTOR_MEDIUM).otherwise(1.0)
        * factor(ind >= 2, FACTOR_PHRASES)
    )
    violations = labels_where(
        [
            (fab, F.lit("hallucination_fabricated_source")),
            (uns, F.lit("hallucination_unsupported")),
            (low, F.lit("hallucination_low_confidence")),
            (ind >= 3, F.lit("hallucination_unsupported")),
        ]
    )
    one = lambda flag, text: F.when(flag, F.array(text)).otherwise(empty)
    details = F.concat(
        one(fab, F.concat(F.lit("Referenced non-existent sources: "), _listed(F.col("_fab")))),
        F.col("_uns"),
        one(low, F.lit("Model reported low confidence in response")),
        one(ind >= 3, F.concat(F.lit("Multiple unverified claim indicators ("), ind.cast("string"), F.lit(")"))),
    )
    return (
        base.withColumns({"g_violations": violations, "g_details": details, "_score": score})
        .withColumn("g_score", F.when(F.size("g_violations") > 0, F.col("_score")).otherwise(F.lit(1.0)))
        .drop("_fab", "_uns", "_ind", "_conf", "_score")
    )


def output_guard(
    df: DataFrame,
    answer: str,
    context: str,
    sources: str | None = None,
    claimed: str | None = None,
    confidence: str | None = None,
    toxicity: bool = True,
    grounding: bool = True,
    cutoff: float = LOW_CONFIDENCE,
) -> DataFrame:
    """Add ``passed, violations, details, confidence_score``: toxic blocks, then a score below the cut-off."""
    empty = _strings()
    if grounding:
        scored = grounding_score(df, answer, context, sources, claimed, confidence)
    else:
        scored = df.withColumns({"g_violations": empty, "g_details": empty, "g_score": F.lit(1.0)})
    tox = toxicity_detect(answer) if toxicity else {"violations": empty, "details": empty}
    scored = scored.withColumns({"_tv": tox["violations"], "_td": tox["details"]})
    toxic = F.size("_tv") > 0
    return scored.withColumns(
        {
            "passed": ~toxic & (F.col("g_score") >= cutoff),
            "violations": F.when(toxic, F.col("_tv")).otherwise(F.col("g_violations")),
            "details": F.when(toxic, F.col("_td")).otherwise(F.col("g_details")),
            "confidence_score": F.when(toxic, F.lit(1.0)).otherwise(F.col("g_score")),
        }
    ).drop("_tv", "_td", "g_violations", "g_details", "g_score")


def guard_event(df: DataFrame, stage: str, passed: str = "passed", violations: str = "violations", details: str = "details", sanitized: str | None = None) -> DataFrame:
    """Add ``event_type, stage, rule_triggered, rule, event_details`` for a table of verdicts."""
    ok, listed = F.col(passed), F.col(violations)
    if stage == "input":
        third = F.when(~ok, "input_blocked").when(F.coalesce(F.length(sanitized) > 0, F.lit(False)), "input_sanitized").otherwise("input_passed")
    else:
        third = F.when(~ok, "output_blocked").when(F.size(listed) > 0, "output_flagged").otherwise("output_passed")
    first = F.get(listed, F.lit(0))
    return df.withColumns(
        {
            "event_type": third,
            "stage": F.lit(stage),
            "rule_triggered": F.coalesce(first, F.lit("")),
            "rule": F.coalesce(first, F.lit("none")),
            "event_details": F.array_join(F.col(details), "; "),
        }
    )


def event_record(events: DataFrame, ts: str, question: str) -> DataFrame:
    """The log record of each event made by ``guard_event``: when, what, and a digest of the question in place of its text.

    Records of one question, from both stages, share the digest. A NULL question has none.
    """
    score = F.col("confidence_score") if "confidence_score" in events.columns else F.lit(None)
    return events.select(
        "event_type",
        F.col(ts).cast("timestamp").alias("ts"),
        "stage",
        "rule_triggered",
        "violations",
        F.col("event_details").alias("details"),
        score.cast("double").alias("confidence_score"),
        F.sha2(F.col(question), 256).alias("query_hash"),
    )
