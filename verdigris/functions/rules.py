"""Rule cascades over messages and answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import WORD, col

# Patterns of the turn classes.
GREETING = r"(?i)^\s*(hi|hey|hello|yo|good\s+(morning|afternoon|evening)|thanks?|thank\s+you|ok|okay|cool|nice|got\s+it|bye|goodbye|see\s+you|sup)\b[\s!.,?]*$"
OPINION = r"(?i)\b(what do you think|your (opinion|view|take)|should i|career|is it worth|future of|will ai|do you believe|advice)\b"
CONCEPT = r"(?i)\b(what is|what are|how does|how do|explain|derive|prove|why does|difference between|intuition|formula|equation|algorithm|implement)\b"
BACKREF = r"(?i)\b(it|its|that|this|those|these|them|they|there|the former|the latter|the first|the second|the third|above|previous|last one)\b"
OPENERS = ["why", "how", "and", "but", "so", "ok", "okay", "yes", "no", "really", "more", "again", "continue", "go", "also", "then", "what", "which", "explain", "elaborate", "expand", "tell", "show", "give"]

# Wording that answers must not have.
PRAISE = [
    "great question", "that's a great question", "that is a great question", "excellent question", "good question", "interesting question", "that's a really thoughtful question", "that's a thoughtful question",
    "what a great", "what a fascinating", "i love this question", "that's a great point", "that's an interesting", "that's a really important", "fascinating question",
]
PHRASES = [
    "does that make sense", "does that help", "does this help", "do you follow", "is that clear", "let's dive in", "let's break this down", "let's unpack", "i'd be happy to explain", "i'd be happy to help",
    "absolutely!", "certainly!", "of course!", "indeed!", "fantastic!", "as an ai", "as a language model",
]
HEADER, BULLET, NUMBERED = r"(?m)^\s{0,3}#{1,6}\s+\S", r"(?m)^\s{0,3}[-*•]\s+\S", r"(?m)^\s{0,3}\d+[.)]\s+\S"
LABEL = r"(?im)^\s*\*{0,2}(hook|formal definition|worked example|key intuition|step\s*\d+|point\s*\d+|takeaway)\*{0,2}\s*:"

# What a quote must not say to be shown.
INJECTION = "|".join([
    r"ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)",
    r"disregard\s+(all\s+|any\s+|the\s+)?(previous|prior|above)",
    r"forget\s+(everything|all|your)\s",
    r"new\s+instructions?\b",
    r"(system|assistant|user|model)\s*:\s",
    r"</?(system|instruction|prompt)>",
    r"you\s+(must|should|will)\s+always\b",
    r"from\s+now\s+on\b",
    r"always\s+(recommend|mention|say|include|promote)\b",
    r"your\s+(new\s+)?(role|task|instruction)\s+is\b",
    r"\bprompt\s+injection\b",
])


def _words(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD))


def classify_turn(message: Column | str, has_history: Column) -> Column:
    """struct(kind, retrieve, top_k, extract): greeting, opinion, concept, follow-up, in this order."""
    text = F.trim(F.coalesce(col(message), F.lit("")))
    n = _words(text)

    def plan(kind: str, retrieve: bool, top_k: int, extract: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(retrieve).alias("retrieve"), F.lit(top_k).alias("top_k"), F.lit(extract).alias("extract"))

    return (
        F.when((text == "") | text.rlike(GREETING), plan("greeting", False, 0, False))
        .when(text.rlike(OPINION), plan("opinion", True, 6, True))
        .when(text.rlike(CONCEPT) | (n > 12), plan("concept", True, 10, True))
        .when(has_history, plan("followup", True, 8, True))
        .otherwise(plan("concept", True, 10, True))
    )


def needs_rewrite(message: Column | str, has_history: Column) -> Column:
    """Whether a message seems to lean on the turns before it."""
    m = F.coalesce(col(message), F.lit(""))
    n = _words(m)
    first = F.lower(F.regexp_extract(m, f"({WORD})", 1))
    return F.when(~has_history | (n == 0), False).otherwise((n <= 4) | ((n <= 18) & m.rlike(BACKREF)) | (first.isin(OPENERS) & (n <= 6)))


def _praises(x: Column) -> Column:
    head = F.regexp_replace(F.element_at(F.split(F.lower(x), r"(?<=[.!?])\s", 2), 1), "^[\"'*_ ]+", "")
    out = F.lit(False)
    for p in PRAISE:
        out = out | head.startswith(p)
    return out


def violations(text: Column | str) -> Column:
    """Array of struct(rule, severity), a row for each rule broken and each phrase found."""
    raw = F.coalesce(col(text), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(raw, "^\\s+", ""), "\\s+$", "")

    def hit(rule: str, severity: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))

    found = [
        hit("banned_opener", "error", _praises(bare)),
        *[hit("banned_phrase", "warn", F.lower(bare).contains(p)) for p in PHRASES],
        hit("markdown_header", "warn", bare.rlike(HEADER)),
        hit("bullet_list", "warn", bare.rlike(BULLET)),
        hit("numbered_list", "warn", bare.rlike(NUMBERED)),
        hit("scaffold_label", "warn", bare.rlike(LABEL)),
        hit("unfinished", "error", ~F.substring(bare, -1, 1).isin(list(".!?\"')]:"))),
    ]
    empty = F.array(F.struct(F.lit("empty").alias("rule"), F.lit("error").alias("severity")))
    return F.when(bare == "", empty).otherwise(F.filter(F.array(*found), lambda v: v.isNotNull()))


def repair(text: Column | str) -> Column:
    """Without a first sentence that only praises, bullets unwrapped."""
    bare = F.trim(col(text))
    cut = F.when(_praises(bare) & bare.rlike(r"[.!?]\s+\S"), F.regexp_replace(bare, r"(?s)^.*?[.!?]\s+(.*)$", "$1")).otherwise(bare)
    return F.trim(F.regexp_replace(cut, r"(?m)^\s{0,3}[-*•][-*• ]*\s*(\S)", "$1"))


def sanitize_evidence(raw: Column | str, size: int = 200) -> Column:
    """A quote that is safe to show; empty if it is not."""
    text = F.regexp_replace(F.coalesce(col(raw), F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", " ")
    text = F.trim(F.regexp_replace(text, "\\s+", " "))
    text = F.translate(text, "<>", "()")
    cut = F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("..."))).otherwise(text)
    return F.when(text.rlike(f"(?i){INJECTION}"), F.lit("")).otherwise(cut)


def authority_prior(kind: Column | str, prior: Column) -> Column:
    """Authority of a kind of source, unless one is set already."""
    by_kind = F.when(col(kind) == "paper", 0.8).when(col(kind) == "qa", 0.6).when(col(kind) == "newsletter", 0.5).otherwise(0.4)
    return F.when((prior == 1.0) & (col(kind) != "lecture"), by_kind).otherwise(prior)


def first_match(text: Column | str, cases: list[tuple[str, list[str]]], other: str) -> Column:
    """The first label of which a keyword is in the lower-cased text."""
    out: Column | None = None
    low = F.lower(col(text))
    for label, keys in cases:
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(other) if out is None else out.otherwise(other)
