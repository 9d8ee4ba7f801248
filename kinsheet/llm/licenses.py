"""Licence scans with DataFrame functions only: TF-IDF cosine to templates, then inheritance."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsheet.llm.common import literal_table
from kinsheet.session import materialize

#: Cosine that a header or a licence file has to reach.
THRESHOLD = 0.7
#: Names of files that speak for their directory. Fixed value.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
#: Short and long forms of licence statements. Fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "proprietary": ["All rights reserved."],
}

NOT_WORD = r"[^a-z0-9.]+"
#: Sentences and lines are units that are compared.
UNIT_END = r"\n+|(?<=[.!?;])[\x20\x09-\x0D]+"
#: Marks of comment lines, at both ends.
COMMENT = r"(?m)^[\x20\x09]*(?:#+|//+|/?\*+/?|--+|;+|%+)[\x20\x09]*|[\x20\x09\r]*(?:\*+/)?$"
#: A copyright line is no part of the sentence after it.
OWNER_LINE = r"(?im)^[\x20\x09]*((?:copyright|\(c\)|©)[^\n]*)$"
#: A line that goes on in the next one.
WRAP = r"(?<!\n)\n(?!\n)"


def words_of(text: str) -> list[str]:
    found = (w.strip(".") for w in re.split(NOT_WORD, text.lower()))
    return [w for w in found if w]


def _words(text: Column) -> Column:
    trimmed = F.transform(F.split(F.lower(text), NOT_WORD), lambda w: F.btrim(w, F.lit(".")))
    return F.filter(trimmed, lambda w: w != "")


def weights(frequency: dict[str, int], documents: int) -> dict[str, float]:
    """Inverse document frequencies; a word without a count weighs ``idf_of(0)``."""
    return {t: math.log((1 + documents) / (1 + n)) + 1 for t, n in frequency.items()}


def vectors(idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """``(licence, unit vector)`` of every template."""
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            raw = {w: words.count(w) * idf[w] for w in words}
            size = math.sqrt(sum(x * x for x in raw.values()))
            out.append((name, {w: x / size for w, x in raw.items()}))
    return out


def needed_words(templates: list[tuple[str, dict[str, float]]], least: float) -> list[str]:
    """Words of which a unit has at least one if its cosine to any template is ``least``.

    The lightest words of a template whose joint length stays below ``least`` cannot reach
    it without one of the others.
    """
    needed = set()
    for _, vector in templates:
        left = 0.0
        for word, weight in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            left += weight * weight
            if math.sqrt(left) >= least - 1e-9:
                needed.add(word)
    return sorted(needed)


def _unwrapped(text: Column) -> Column:
    """A text without comment marks, its paragraphs as one line each."""
    bare = F.regexp_replace(text, COMMENT, "")
    apart = F.regexp_replace(bare, OWNER_LINE, "\n$1\n")
    return F.regexp_replace(apart, WRAP, " ")


def _document_frequency(texts: DataFrame) -> tuple[dict[str, int], int]:
    """In how many texts each template word occurs, over all of them."""
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    held = F.array_intersect(_words(F.col("text")), F.lit(vocabulary))
    counted = (
        texts.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    found = {r["word"]: r["n"] for r in counted.collect()}
    return {w: found.get(w, 0) for w in vocabulary}, texts.count()


def statements(docs: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """``(doc_id, path, digest, license, cosine)``: the best template of each text that has one.

    Units are the sentences and lines of whole texts, the sentences of their paragraphs with
    comment marks and line ends taken out, and the whole text of a licence file. Their vectors
    have all their words; a word that no template has weighs as one that no document has. Ties
    go to the first name. A null or empty text has none; a text is known by id, path and the
    hash of the text, so that rows of one path with different texts stay apart.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("path").cast("string").alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", F.xxhash64("text"))
    frequency, documents = _document_frequency(rows)
    idf = weights(frequency, documents)
    templates = vectors(idf)
    needed = "|".join(re.escape(w) for w in needed_words(templates, least))
    held = F.lower(F.col("text")).rlike(f"(?<![a-z0-9])(?:{needed})(?![a-z0-9])")
    whole = F.when(F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)), F.array("text"))
    lines, joined = F.split("text", UNIT_END), F.split(_unwrapped(F.col("text")), UNIT_END)
    whole = F.coalesce(whole, F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(lines, joined, whole))
    # Texts, then units, without a needed word cannot reach any template and are left here.
    unit = (
        rows.where(held)
        .select("doc_id", "path", "digest", F.posexplode(units).alias("unit", "text"))
        .where(held)
    )
    key = ["doc_id", "path", "digest", "unit"]
    word = unit.select(*key, F.explode(_words(F.col("text"))).alias("word"))
    counted = word.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))
    known = literal_table(
        spark, [{"word": w, "idf": x} for w, x in idf.items()], "word string, idf double"
    )
    rare = math.log(1 + documents) + 1
    weighed = counted.join(known, "word", "left").withColumn(
        "weight", F.col("tf") * F.coalesce("idf", F.lit(rare))
    )
    size = weighed.groupBy(*key).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "weight"))).alias("words"),
    )
    postings = literal_table(
        spark,
        [
            {"word": w, "template": i, "license": name, "share": x}
            for i, (name, vector) in enumerate(templates)
            for w, x in vector.items()
        ],
        "word string, template int, license string, share double",
    )
    shared = size.select(*key, "size", F.inline("words")).join(postings, "word")
    scored = shared.groupBy(*key, "template", "license").agg(
        (F.sum(F.col("weight") * F.col("share")) / F.first("size")).alias("cosine")
    )
    best = F.struct((-F.round("cosine", 9)).alias("far"), "license")
    return (
        scored.where(F.col("cosine") >= least)
        .groupBy("doc_id", "path", "digest")
        .agg(F.min(best).alias("best"))
        .select("doc_id", "path", "digest", "best.license", (-F.col("best.far")).alias("cosine"))
    )


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def scan(docs: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """``(doc_id, path, license, cosine, effective, inherited_from)``, a row a document.

    ``docs(doc_id, path, text)``; ``license`` is what the text itself states. A document
    without a statement takes that of the nearest directory above it with a licence file that
    has one (of several files, the best, then the first by name). Directories are resolved
    once each, then joined to their documents, so a crowded directory is one row until then.
    A null path inherits nothing. Repeated rows are repeated; an empty table gives none.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("path").cast("string").alias("path"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"),
    )
    found = materialize(statements(docs, least))
    own = found.where(F.col("path").rlike(LICENSE_FILE)).groupBy(_directory(F.col("path")).alias("up"))
    own = own.agg(
        F.min(F.struct((-F.col("cosine")).alias("far"), "license", "path")).alias("best")
    ).select("up", F.col("best.license").alias("given"))
    directory = rows.select(_directory(F.col("path")).alias("directory")).where("directory IS NOT NULL")
    # Every prefix of a directory that ends in a slash, and the root.
    names = F.split(F.regexp_replace("directory", "/$", ""), "/")
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(names))
    above = directory.distinct().select(
        "directory", names.alias("names"), F.explode(F.sequence(F.lit(0), depth)).alias("n")
    )
    prefix = F.concat(
        F.array_join(F.slice("names", F.lit(1), F.col("n")), "/"),
        F.when(F.col("n") > 0, "/").otherwise(""),
    )
    resolved = (
        above.select("directory", "n", prefix.alias("up"))
        .join(own, "up")
        .groupBy("directory")
        .agg(F.max(F.struct("n", "given", "up")).alias("near"))
        .select("directory", "near.given", "near.up")
    )
    stated = found.select(
        F.col("doc_id").alias("_id"),
        F.col("path").alias("_path"),
        F.col("digest").alias("_digest"),
        "license",
        "cosine",
    )
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    same &= F.col("path").eqNullSafe(F.col("_path"))
    inherits = F.col("license").isNull()
    return (
        rows.join(stated, same, "left")
        .withColumn("directory", _directory(F.col("path")))
        .join(resolved, "directory", "left")
        .select(
            "doc_id",
            "path",
            "license",
            "cosine",
            F.coalesce("license", "given").alias("effective"),
            F.when(inherits, F.col("up")).alias("inherited_from"),
        )
    )
