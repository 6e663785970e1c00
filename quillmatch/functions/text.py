"""Tokenizers and token tests as Column factories; everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anything but a letter, a number or an underscore parts words.
NON_WORD = r"[^\p{L}\p{N}_]+"


def splitter(body: Column, delimiter: str = ",") -> Column:
    """Upper-cased words; every run of other characters parts them."""
    return F.array_remove(F.split(F.upper(F.coalesce(body, F.lit(""))), NON_WORD), "")


def _compressed(token: Column) -> Column:
    return F.regexp_replace(token, NON_WORD, "")


def compress(body: Column, delimiter: str = ",") -> Column:
    """Upper-cased fields and words, with other characters taken out of each word."""
    spaced = F.replace(F.upper(F.coalesce(body, F.lit(""))), F.lit(delimiter), F.lit(" "))
    return F.array_remove(F.transform(F.split(spaced, r"\s+"), _compressed), "")


def compress_numbers(body: Column, delimiter: str = ",") -> Column:
    """As compress(), but consecutive numbers of one field are joined. A word without word
    characters stays as an empty token, and ends a run of numbers."""
    fields = F.split(F.upper(F.coalesce(body, F.lit(""))), re.escape(delimiter))

    def field(text: Column) -> Column:
        words = F.transform(F.array_remove(F.split(text, r"\s+"), ""), _compressed)
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run"))

        def flushed(acc: Column) -> Column:
            return F.when(acc["run"] != "", F.array_append(acc["out"], acc["run"])).otherwise(acc["out"])

        def step(acc: Column, w: Column) -> Column:
            digits = is_digit(w)
            out = F.when(digits, acc["out"]).otherwise(F.array_append(flushed(acc), w))
            return F.struct(out.alias("out"), F.when(digits, F.concat(acc["run"], w)).otherwise(F.lit("")).alias("run"))

        return F.aggregate(words, start, step, flushed)

    return F.flatten(F.transform(fields, field))


TOKENIZERS = {"Splitter": splitter, "Compress": compress, "CompressNbr": compress_numbers}


def tokenizer(name: str):
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizerType {name!r}; known: {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name]


def is_digit(token: Column) -> Column:
    return F.rlike(token, F.lit(r"^\p{Nd}+$"))


def is_alpha(token: Column) -> Column:
    return F.rlike(token, F.lit(r"^\p{L}+$"))


def is_numeric(token: Column) -> Column:
    return F.rlike(token, F.lit(r"^\p{N}+$"))


def split_name_address(tokens: Column) -> tuple[Column, Column]:
    """The tokens before the first one that holds a digit, and those from it on."""
    at = F.array_position(F.transform(tokens, lambda t: F.rlike(t, F.lit(r"\p{Nd}"))), True)
    name = F.when(at == 0, tokens).otherwise(F.slice(tokens, F.lit(1), (at - 1).cast("int")))
    address = F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(tokens, at.cast("int"), F.size(tokens)))
    return name, address


def base_name(path: str) -> str:
    """A file's name without its folder and last extension."""
    name = re.split(r"[/\\]", path)[-1]
    return name.rpartition(".")[0] or name
