"""Text functions of query understanding and keyword search, as Spark columns.

Words are runs of letters, numbers and underscores of any script; word edges are asked for with
lookarounds, as the JVM's ``\\b`` knows ASCII only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X

WORD = r"[\p{L}\p{N}_]+"
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return _any([text.contains(p) for p in phrases])


def word_in(text: Column, phrase: str) -> Column:
    """Whether ``phrase`` stands in ``text`` between word edges."""
    return text.rlike(f"{BEFORE}{phrase}{AFTER}")


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def tokens(text: Column) -> Column:
    """Lower-case words without stop-words and single characters; all of them where that leaves none."""
    return tokens_of(raw_words(text))


def tokens_of(words: Column) -> Column:
    """The same of a text's ``raw_words``, where those are a column of their own: so they are found once a text."""
    kept = F.filter(words, lambda w: ~w.isin(*X.STOP_WORDS) & (F.length(w) > 1))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def _repeated(items: Column, times: int) -> Column:
    return F.flatten(F.transform(items, lambda x: F.array_repeat(x, times)))


def boosted_tokens(query: Column) -> Column:
    """Tokens of a query, with capitalised words thrice more, codes and quoted words four times more."""
    names = F.filter(F.regexp_extract_all(query, F.lit(rf"{BEFORE}(\p{{Lu}}\p{{Ll}}+){AFTER}"), 1), lambda w: (F.length(w) > 2) & ~query.startswith(w))
    codes = F.regexp_extract_all(query, F.lit(rf"{BEFORE}([A-Z0-9\-]{{2,}}){AFTER}"), 1)
    quoted = F.flatten(F.transform(F.regexp_extract_all(query, F.lit('["“]([^"”]+)["”]'), 1), tokens))
    low = lambda a: F.transform(a, F.lower)
    return F.concat(tokens(query), _repeated(low(names), 3), _repeated(low(codes), 4), _repeated(quoted, 4))


def substitute(text: Column) -> Column:
    """Ambiguous phrases replaced before translation."""
    return reduce(lambda t, s: F.regexp_replace(t, f"(?iu){BEFORE}{s[0]}{AFTER}", s[1]), X.SUBSTITUTIONS, F.coalesce(text, F.lit("")))


def without_stutter(text: Column) -> Column:
    """At most two equal words in a row, whatever their case."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    state = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        same = F.lower(w) == s["last"]
        n = F.when(same & (F.size(s["out"]) > 0), s["n"] + 1).otherwise(0)
        return F.struct(F.lower(w).alias("last"), n.alias("n"), F.when(n < 2, F.concat(s["out"], F.array(w))).otherwise(s["out"]).alias("out"))

    return F.array_join(F.aggregate(words, state, step, lambda s: s["out"]), " ")


def intent(text: Column) -> Column:
    """``struct(intent, dense_weight, sparse_weight)``: whether a query asks for text in a picture or for a scene."""
    upper, lower = r"\p{Lu}", r"\p{Ll}"
    code = text.rlike(rf"{BEFORE}(?:{upper}{{2,}}[0-9\-]*|{upper}+-[0-9]+){AFTER}")
    name = rf"{BEFORE}{upper}{lower}+(?:\s+{upper}{lower}+)+{AFTER}"
    inner = F.transform(F.split(text, r"[.?!\n]+"), lambda s: F.regexp_replace(strip(s), r"^\S+\s*", ""))
    wanted = contains_any(F.lower(text), X.TEXT_CUES) | code | F.exists(inner, lambda s: s.rlike(name)) | text.rlike('["“][^"”]{3,}["”]')
    made = lambda kind, dense, sparse: F.struct(F.lit(kind).alias("intent"), F.lit(dense).alias("dense_weight"), F.lit(sparse).alias("sparse_weight"))
    return F.when(wanted, made("OCR_TEXT", 0.4, 0.6)).otherwise(made("VISUAL_SCENE", 0.75, 0.25))


def prompts(text: Column) -> Column:
    """The prompt ensemble of an English query: frames around it, and around its first sentences if it has several."""
    bare = F.regexp_replace(strip(text), r"\.+$", "")
    bare = strip(F.regexp_replace(bare, rf"(?i)^(?:{'|'.join(X.PROMPT_OPENINGS)})\s+", ""))
    sentences = F.filter(F.transform(F.split(bare, r"[.;\n]+"), strip), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 3)
    framed = F.array(*[F.concat(F.lit(f), bare) for f in X.PROMPT_FRAMES])
    more = F.flatten(F.transform(F.slice(sentences, 1, 3), lambda s: F.array(*[F.concat(F.lit(f), s) for f in X.SENTENCE_FRAMES])))
    every = F.when(F.size(sentences) > 1, F.concat(framed, more)).otherwise(framed)
    return F.array_distinct(F.filter(every, lambda p: F.length(strip(p)) > 3))


def with_domain_prompts(given: Column, query: Column, domains: Mapping[str, str] = X.DOMAIN_PROMPTS) -> Column:
    """Prompts of what a query's words are known to show come first, three of each; without known words the prompts stay."""
    low = F.lower(F.coalesce(query, F.lit("")))
    none = F.array().cast("array<string>")
    more = [F.when(word_in(low, re.escape(w)), F.array(F.lit(d), F.lit(f"a photo of {d}"), F.lit(f"a video scene of {d}"))).otherwise(none) for w, d in domains.items()]
    return F.concat(*more, given) if more else given


def neutral_question(question: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"(?iu){BEFORE}{p}{AFTER}", X.NEUTRAL), X.NEUTRAL_PHRASES, question)


# ---- query files


def task_of_name(query_id: Column) -> Column:
    """Task that a query's name ends in or holds between dashes or underscores; null if none."""
    low = F.lower(query_id)
    named = lambda names: _any([low.endswith(n) | low.contains(f"-{n}-") | low.contains(f"_{n}_") for n in names])
    return F.when(named(["kis"]), "kis").when(named(["qa", "vqa"]), "qa").when(named(["trake", "event"]), "trake")


def without_question_label(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?iu)^(?:{'|'.join(X.QUESTION_LABELS)})\s*[:.]?\s*", ""))


def split_by_sentence(lines: Column) -> Column:
    """``struct(query, question)`` of a file that is named a question: sentences with a mark or an opening are the question."""
    sentences = F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"(?<=[.!?])\s+"), strip))), lambda s: s != "")
    asks = lambda s: s.contains("?") | s.rlike(rf"(?iu)^(?:{'|'.join(X.QUESTION_OPENINGS)}){AFTER}")
    asked = F.filter(F.transform(F.filter(sentences, asks), without_question_label), lambda s: s != "")
    told = F.filter(sentences, lambda s: ~asks(s))
    return _or_all(lines, told, asked)


def split_by_line(lines: Column) -> Column:
    """The same from content: everything from the first line with a question mark on is the question."""
    marked = lambda x: contains_any(F.lower(x), X.QUESTION_LINE_MARKS)
    first = F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(marked(x), i)), lambda i: i.isNotNull())), F.size(lines))
    told = F.filter(lines, lambda x, i: i < first)
    asked = F.filter(F.transform(F.filter(lines, lambda x, i: i >= first), lambda x: F.when(marked(x), without_question_label(x)).otherwise(x)), lambda s: s != "")
    return _or_all(lines, told, asked)


def _or_all(lines: Column, told: Column, asked: Column) -> Column:
    whole = F.array_join(lines, "\n")
    pick = lambda parts: F.coalesce(F.nullif(strip(F.array_join(parts, " ")), F.lit("")), whole)
    return F.struct(pick(told).alias("query"), pick(asked).alias("question"))


def event_lines(lines: Column) -> Column:
    """Lines without their ordinal or label; all lines as they are if nothing is left."""
    cleaned = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, rf"(?iu)^{X.EVENT_LABEL}\s*\d*\s*[:.]?\s*", ""))), lambda x: x != "")
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(lines)


def parse_query(query_id: Column, lines: Column) -> Column:
    """``struct(task, query, question, events)`` of a query file's name and lines: by name, else by content."""
    lines = F.filter(F.transform(lines, strip), lambda x: x != "")
    whole = F.array_join(lines, "\n")
    none = F.array().cast("array<string>")

    def made(task: str, query: Column, question: Column, events: Column) -> Column:
        return F.struct(F.lit(task).alias("task"), query.alias("query"), question.alias("question"), events.alias("events"))

    named, empty = task_of_name(query_id), F.lit("")
    by_sentence, by_line, events = split_by_sentence(lines), split_by_line(lines), event_lines(lines)
    has_events = F.exists(lines, lambda x: x.rlike(f"(?iu)^{X.EVENT_LABEL}")) & (F.size(lines) >= 3)
    trake = made("trake", F.array_join(events, " "), empty, events)
    return (
        F.when(named == "kis", made("kis", F.array_join(lines, " "), empty, none))
        .when(named == "qa", made("qa", by_sentence["query"], by_sentence["question"], none))
        .when(named == "trake", trake)
        .when(contains_any(F.lower(whole), X.QUESTION_MARKS), made("qa", by_line["query"], by_line["question"], none))
        .when(has_events, trake)
        .otherwise(made("kis", whole, empty, none))
    )


def natural_key(path: Column) -> Column:
    """Sorts digit runs by value: lower-cased, with runs of digits padded."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")), 20, "0")).otherwise(p)), "")


# ---- answers


def clean_opening(answer: Column, question: Column) -> Column:
    """A long answer's quoted core, and an answer without the question that it repeats."""
    ans = strip(answer)
    core = strip(F.regexp_extract(ans, '["“]([^"”]+)["”]', 1))
    ans = F.when((F.length(core) > 2) & (F.length(ans) > 60), core).otherwise(ans)
    asked = F.regexp_replace(strip(question), r"\?+$", "")
    echoes = (F.length(question) > 10) & F.lower(ans).startswith(F.lower(asked))
    return F.when(echoes, F.regexp_replace(F.substr(ans, F.length(asked) + 1), "^[ :là,.\\-]+", "")).otherwise(ans)


def finish_answer(answer: Column) -> Column:
    """Quotes and closing marks gone, refusals replaced, at most 100 characters."""
    ans = F.regexp_replace(F.trim(F.trim(strip(answer), F.lit('"')), F.lit("'")), "[.!?;:]+$", "")
    cut = F.when(F.length(ans) > 100, strip(F.substring(ans, 1, 100))).otherwise(ans)
    return F.when(contains_any(F.lower(ans), X.REFUSALS) | (cut == ""), X.UNKNOWN).otherwise(cut)


def answer_score(answer: Column, rank: Column) -> Column:
    """Confidence in an answer of a candidate at ``rank`` (from 0)."""
    n = F.length(answer)
    base = F.lit(50.0) - rank * 3.0
    none = answer.isNull() | (answer == "") | F.lower(answer).isin(*X.NO_ANSWERS)
    return F.when(none, -100.0).when(n.between(3, 70), base + 10).when(n > 100, base - 10).otherwise(base)


def quoted_for_csv(answer: Column) -> Column:
    """An answer as a quoted field of at most 100 characters."""
    text = strip(F.coalesce(answer, F.lit("")))
    text = F.when(text.isin("", '""', "''", "None"), X.UNKNOWN).otherwise(text)
    bare = strip(F.regexp_replace(F.trim(F.trim(text, F.lit('"')), F.lit("'")), "\n", " "))
    bare = F.when(F.length(bare) > 100, strip(F.substring(bare, 1, 100))).otherwise(bare)
    bare = F.when(bare == "", X.UNKNOWN).otherwise(bare)
    return F.concat(F.lit('"'), F.replace(bare, F.lit('"'), F.lit('""')), F.lit('"'))


def verification_score(answer: Column) -> Column:
    """0 to 10: the number behind ``Score:``, else 8 for agreement and 1 without."""
    told = F.regexp_extract(answer, r"(?i)Score:\s*([0-9]+(?:\.[0-9]+)?)", 1)
    score = F.when(told != "", told.cast("double")).when(contains_any(F.lower(answer), X.AGREEING), 8.0).otherwise(1.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0))


def answers_match(given: Column, wanted: Column) -> Column:
    """Equal, one within the other, or with a common word; never for empty ones."""
    a, b = strip(F.lower(F.coalesce(given, F.lit("")))), strip(F.lower(F.coalesce(wanted, F.lit(""))))
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return (a != "") & (b != "") & ((a == b) | a.contains(b) | b.contains(a) | F.arrays_overlap(words(a), words(b)))
