"""Text functions as column expressions. Results follow Python's str methods where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import taxonomy
from tessella.functions.question_patterns import OTHER_OF, OTHERS, PHRASES, SELF, SUBJECTS

#: What str.split() takes for white space, inside a character class.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Of these, what the pattern \\s leaves out.
_OTHER_SPACE = "".join(chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def lookup(values: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """The value of ``key``, or ``default`` (null)."""
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
    return found if default is None else F.coalesce(found, default)


def word_count(text: Column) -> Column:
    """len(text.split()); null is 0. Other white space becomes a space first, because the short class
    takes a quarter of the time that the long one does."""
    return F.coalesce(F.regexp_count(F.translate(text, _OTHER_SPACE, " " * len(_OTHER_SPACE)), F.lit(r"\S+")), F.lit(0))


def is_blank(text: Column) -> Column:
    """None, empty, or white space alone."""
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))


def char_length(text: Column) -> Column:
    """Code points."""
    return F.length(text)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def strip_label_prefix(label: Column, spaces: bool = False) -> Column:
    out = F.regexp_replace(label, f"^{taxonomy.LABEL_PREFIX}", "")
    return F.replace(out, F.lit("_"), F.lit(" ")) if spaces else out


def normalize_taxonomy_label(label: Column) -> Column:
    """Trimmed, lower-cased, with underscores and the prefix, known typos mended; null or empty fails."""
    trimmed = F.replace(F.lower(F.regexp_replace(label, f"^[{SPACE}]+|[{SPACE}]+$", "")), F.lit(" "), F.lit("_"))
    marked = F.when(trimmed.startswith(taxonomy.LABEL_PREFIX), trimmed).otherwise(F.concat(F.lit(taxonomy.LABEL_PREFIX), trimmed))
    for wrong, right in taxonomy.TYPOS.items():
        marked = F.replace(marked, F.lit(wrong), F.lit(right))
    return F.when(label.isNull(), F.raise_error(F.lit("null taxonomy label"))).when(trimmed == "", F.raise_error(F.lit("empty taxonomy label"))).otherwise(marked)


def normalize_topic(topic: Column) -> Column:
    """Aliases replaced; null stays null."""
    return lookup(taxonomy.TOPIC_ALIASES, topic, topic)


def display_label(label: Column) -> Column:
    raw = strip_label_prefix(label, spaces=True)
    return lookup(taxonomy.DISPLAY, raw, F.initcap(raw))


def bin_label(topic: Column, format_: Column) -> Column:
    return F.concat_ws(" / ", display_label(topic), display_label(format_))


def last_sentence(text: Column) -> Column:
    """What follows the last sentence end of the trimmed text; the text itself if it has but one."""
    parts = F.split(F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", ""), r"(?<=[.!?])\s+")
    return F.when(F.size(parts) <= 1, text).otherwise(F.element_at(parts, -1))


def choice_key(index: Column, count: Column) -> Column:
    """A, B, ... for up to 26 choices, choice_<zero-padded index> beyond; at least two choices."""
    wide = F.length((count - 1).cast("string"))
    return (
        F.when(count < 2, F.raise_error(F.lit("at least two choices are needed")))
        .when(count <= 26, F.char((index + 65).cast("bigint")))
        .otherwise(F.concat(F.lit("choice_"), F.lpad(index.cast("string"), wide, F.lit("0"))))
    )


def escape_component(text: Column) -> Column:
    """A query-id component: % and : are percent-encoded."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))


def normalize_answer(text: Column) -> Column:
    """White space runs become one space, ends and final full stops go, lower-cased."""
    squeezed = F.regexp_replace(F.regexp_replace(text, f"[{SPACE}]+", " "), "^ | $", "")
    return F.lower(F.regexp_replace(squeezed, r"[. ]+$", ""))


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def split_last(text: Column, mark: str = "__") -> tuple[Column, Column]:
    """What precedes and follows the last ``mark``; nulls if there is none."""
    at = F.length(text) - F.instr(F.reverse(text), mark[::-1]) - (len(mark) - 2)
    has = F.contains(text, F.lit(mark))
    return F.when(has, F.substring(text, F.lit(1), at - 1)), F.when(has, F.substring(text, at + len(mark), F.length(text)))


def question_phrase(question: Column) -> Column:
    """The class of the first phrase that the question holds, in any case; else other."""
    out = F.lit("other")
    for phrase, label in reversed(PHRASES):
        out = F.when(F.contains(F.lower(question), F.lit(phrase)), label).otherwise(out)
    return out


def reasoning_type(question: Column, actor: Column | None = None, subject: Column | None = None) -> Column:
    """The reasoning class of a question's last sentence, or null: first what it asks about others,
    then about the actor. If another known person than the actor is the subject, the class for the
    actor becomes that for others."""
    last = last_sentence(question)
    out = F.lit(None).cast("string")
    for label, pattern in reversed(SELF):
        what = F.lit(label)
        if actor is not None and subject is not None and label in OTHER_OF:
            what = F.when(actor.isNotNull() & subject.isNotNull() & (actor != subject), OTHER_OF[label]).otherwise(label)
        out = F.when(last.rlike("(?i)" + pattern), what).otherwise(out)
    for label, pattern in reversed(OTHERS):
        out = F.when(last.rlike("(?i)" + pattern), label).otherwise(out)
    return out


def question_subject(question: Column, label: Column) -> Column:
    """Whom a question of a class is about, lower-cased: the first pattern that fits; else null."""
    out = F.lit(None).cast("string")
    for name, patterns in SUBJECTS.items():
        found = F.coalesce(*[F.nullif(F.regexp_extract(question, "(?i)" + p, 1), F.lit("")) for p in patterns])
        out = F.when(label == name, F.lower(found)).otherwise(out)
    return out


def asked(text: Column) -> Column:
    """What follows ``Question:`` on its line, trimmed; without that the whole text."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"Question:\s*([^\n]+)", 1)), F.lit("")), text)


def subject_of_task(task: Column) -> Column:
    """The subject in a task's name, mmlu_ taken off; null if empty."""
    return F.nullif(F.regexp_replace(task, "^mmlu_", ""), F.lit(""))


def first_known(text: Column, names: list[str]) -> Column:
    """The first known name among the words of the text's first sentence, lower-cased, or null."""
    first = F.element_at(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1)
    found = F.filter(F.transform(F.split(first, f"[{SPACE}]+"), lambda w: F.lower(F.regexp_replace(w, r"^[,.;:'\"]+|[,.;:'\"]+$", ""))), lambda w: w.isin(names))
    return F.when(F.size(found) > 0, F.element_at(found, 1))
