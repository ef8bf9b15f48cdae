"""Text expressions: tokenising, clean-up, formulas, rewriting."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACE = r"[ \t\n\r\f]+"
UNICODE_SPACE = r"(?U)\s+"
LUCENE = '+-&|!(){}[]^"~*?:\\'


def tokens(text: Column, mode: str = "ascii") -> Column:
    """Words (split at ASCII or Unicode white space) or, with ``char``, single characters."""
    if mode == "char":
        return F.filter(F.split(text, ""), lambda x: x != "")
    if mode not in ("ascii", "unicode"):
        raise ValueError(f"unknown tokenizer {mode!r}")
    return F.filter(F.split(text, ASCII_SPACE if mode == "ascii" else UNICODE_SPACE), lambda x: x != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Stripped, runs of white space as one space, null as empty."""
    return F.coalesce(F.regexp_replace(strip(text), r"(?U)\s+", " "), F.lit(""))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "\n", " ")


def answer_only(text: Column) -> Column:
    """A model's reply without its role mark."""
    return strip(F.regexp_replace(text, r"^assistant:\s*", ""))


def without_fences(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def titled(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def query_safe(text: Column) -> Column:
    """Full-text query syntax characters as spaces; null where nothing is left."""
    return F.nullif(F.trim(F.translate(text, LUCENE, " " * len(LUCENE))), F.lit(""))


def _java(replacement: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def rewrite(query: Column, rules: Mapping[str, str]) -> Column:
    """All matches of the first rule that matches are replaced; later rules don't apply."""
    out = query
    for pattern, replacement in reversed(list(rules.items())):
        out = F.when(query.rlike(pattern), F.regexp_replace(query, pattern, _java(replacement))).otherwise(out)
    return out


def decompose(query: Column, rules: Mapping[str, str]) -> Column:
    """One sub-query for each rule that matches, or the query alone."""
    hits: Sequence[Column] = [F.when(query.rlike(p), F.regexp_replace(query, p, _java(r))) for p, r in rules.items()]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(F.array(query))


_LATEX = (r"\\[a-zA-Z]+", r"\$\$.*?\$\$", r"\$[^$\n]+?\$", r"\\\[.*?\\\]", r"\\\(.*?\\\)")
_PREAMBLE = r"(?i)\\documentclass\{[^}]+\}|\\usepackage(\[[^\]]*\])?\{[^}]+\}|\\(begin|end)\{document\}"


def has_latex(text: Column) -> Column:
    out = F.lit(False)
    for p in _LATEX:
        out = out | text.rlike("(?s)" + p)
    return F.coalesce(out, F.lit(False))


def without_preamble(text: Column) -> Column:
    return F.regexp_replace(text, _PREAMBLE, "")


def _display(inner: Column) -> Column:
    return F.concat(F.lit("$$\n"), inner, F.lit("\n$$"))


def formula(text: Column) -> Column:
    """A formula cell as Markdown: display formulas on lines of their own, text with inline ones as it is."""

    def one(t: Column) -> Column:
        inner = strip(t.substr(F.lit(3), F.greatest(F.length(t) - 4, F.lit(0))))
        bare = F.when(t.contains("usepackage"), without_preamble(t)).otherwise(t)
        ticked = F.regexp_replace(bare, "(?s)^`(.*)`$", "$1")
        return (
            F.when(t.startswith("$$") & t.endswith("$$"), F.when(~inner.contains("$"), _display(inner)).otherwise(t))
            .when(t.startswith("\\[") & t.endswith("\\]"), _display(inner))
            .when(t.rlike(r"\\\[.*\\\]") | t.rlike(r"\$([^$]+)\$") | ~has_latex(t), t)
            .otherwise(_display(ticked))
        )

    return F.transform(F.array(strip(text)), one)[0]


def spaced_formulas(markdown: Column) -> Column:
    """Every $$...$$ with its marks on lines of their own."""
    return F.regexp_replace(markdown, r"(?s)\$\$\n?(.*?)\n?\$\$", "\\$\\$\n$1\n\\$\\$")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; nested plain expressions would be copied for each use."""
    return F.transform(F.array(value), body)[0]


def chunks(words: Column, size: int = 1024, overlap: int = 20) -> Column:
    """Word windows of ``size`` that share ``overlap`` words: array<struct<pos, text>>."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
        window = lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i * step + 1, size), " ").alias("text"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window))

    return let(words, cut)


def valid_input(text: Column, most: int) -> Column:
    return F.coalesce((F.length(strip(text)) > 0) & (F.length(text) <= most), F.lit(False))


_NAME, _ARROW = r"\w+(?:\s+\w+)*", r"\s*->\s*"
ENTITY_LINE = f"(?imU)^({_NAME}){_ARROW}([a-zA-Z\\s]+?){_ARROW}({_NAME})$"


def entities(text: Column) -> Column:
    """Subjects and objects of lines ``subject -> relation -> object``, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(ENTITY_LINE), 1), F.regexp_extract_all(text, F.lit(ENTITY_LINE), 3)))
