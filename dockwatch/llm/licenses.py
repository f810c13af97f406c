"""License phrases and notices in documents, found by diagonal voting.

Every run of K words of a text is hashed and joined with the runs of all
templates. A match of document position i with template position j votes for
the diagonal i - j; a copy of a template is a diagonal with many votes, and an
edited copy a few neighbouring ones. Votes are counted per diagonal, neighbouring
diagonals at most ``GAP`` apart are merged to spans, whatever lies between them in
the text, and a span counts if enough of its template's runs were seen in it. Phrases and
short notices must be matched in full, word for word, on one diagonal; longer
notices that name a license must show its name, for others use the same sentences.
The words themselves are compared at each vote, so hashes decide nothing.

Templates are a list in this file, so the broadcast side of the join has a
fixed size. Only built-in functions run.

Defined cases: null and empty texts have no words and no labels; a text without
places has null positions and an empty label string; rows equal in doc_id and
text are scanned once and returned as often as they occur; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dockwatch.llm.common import table, text_key
from dockwatch.session import stage

#: Words in a hashed run; the shortest phrase has two.
K = 2
#: Diagonals so far apart still belong to one edited copy.
GAP = 4
#: Share of a notice's runs that a span must show.
COVERAGE = 0.5
#: Notices of fewer runs must be seen in full: half of them is what any license says.
SHORT = 10

# The phrases of the contract with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening sentences of widely used public license notices, with labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction":
        "mit",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in "
    "compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation": "gpl",
    "this work is licensed under a creative commons attribution": "cc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license": "apache",
}

#: The run that a longer notice of a label must show, if it has it.
NAMES = {"apache": "apache license", "gpl": "gnu general", "mpl": "mozilla public"}

#: A letter outside ASCII whose lower case is ASCII would change a word; it is put out of the way.
_ODD = {"İ": "ı", "K": "ĸ"}


def words_of(text: Column) -> Column:
    """Lower-cased words of a text: runs of ASCII letters and digits and of all non-ASCII characters."""
    t = F.coalesce(text, F.lit(""))
    for a, b in _ODD.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.filter(F.split(F.lower(t), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    """One row per run of each template: which, where, its words."""
    rows = []
    for number, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        w = text.split()
        runs = [w[j:j + K] for j in range(len(w) - K + 1)]
        name = NAMES.get(label, "").split()
        for j, run in enumerate(runs):
            rows.append((number, label, number < len(PHRASES), len(runs), j, run,
                         runs.index(name) if name in runs else None))
    df = spark.createDataFrame(
        rows, "tpl int, label string, phrase boolean, runs int, tpos int, twords array<string>, name int")
    return df.withColumn("run", _run_hash([F.col("twords")[i] for i in range(K)]))


def _run_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _runs(words: Column) -> Column:
    """The runs of a text as structs (run, a, b): hash and words."""
    return F.when(F.size(words) >= K, F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
        lambda a, b: F.struct(_run_hash([a, b]).alias("run"), a.alias("a"), b.alias("b"))))


def votes(docs: DataFrame) -> DataFrame:
    """Matches of document runs with template runs, and one row with null ``tpl`` per document."""
    tpl = templates(docs.sparkSession)
    none = tpl.limit(0).unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("run")),
                                    allowMissingColumns=True)
    tpl = tpl.filter(F.col("run") != 0).unionByName(none)
    d = docs.select("doc_id", text_key().alias("_key"), words_of(F.col("text")).alias("_w"))
    blank = F.array(F.struct(F.lit(0).cast("long").alias("run"), F.lit("").alias("a"), F.lit("").alias("b")))
    runs = F.coalesce(_runs(F.col("_w")), F.slice(blank, 1, 0))
    d = d.select("doc_id", "_key", F.size("_w").cast("long").alias("n_words"),
                 F.concat(blank, runs).alias("_r"))
    # The words travel inside the exploded element: a row never drags its whole text along.
    e = d.select("doc_id", "_key", "n_words", F.posexplode("_r").alias("_p", "_e"))
    e = e.select("doc_id", "_key", "n_words", "_p", F.col("_e.run").alias("run"),
                 F.col("_e.a").alias("_a"), F.col("_e.b").alias("_b"))
    m = e.join(F.broadcast(tpl), "run")      # the templates above: a few hundred rows
    m = m.filter(F.when(F.col("tpl").isNull(), F.col("_p") == 0).otherwise(
        (F.col("_p") > 0) & (F.col("_a") == F.col("twords")[0]) & (F.col("_b") == F.col("twords")[1])))
    return m.select("doc_id", "_key", "n_words", "tpl", "label", "phrase", "runs", "name", "tpos",
                    (F.col("_p") - 1).alias("dpos"))


def spans(votes_: DataFrame) -> DataFrame:
    """Verified spans: doc_id, _key, label, phrase, first_word, share of the template seen."""
    key = ["doc_id", "_key", "tpl"]
    diag = (votes_.filter(F.col("tpl").isNotNull())
            .withColumn("diag", F.col("dpos") - F.col("tpos"))
            .groupBy(*key, "label", "phrase", "runs", "name", "diag")
            .agg(F.collect_set("tpos").alias("seen"), F.min("dpos").alias("lo")))
    full = F.col("phrase") | (F.col("runs") < SHORT)
    exact = diag.filter(full & (F.size("seen") == F.col("runs"))).select(
        *key, "label", "phrase", F.col("diag").alias("first_word"), F.lit(1.0).alias("share"))
    # Phrases and short notices lie on one diagonal each. Others: diagonals next to each other, in order of
    # their offset, so a vote elsewhere in the text does not part the halves of an edited copy.
    w = Window.partitionBy(*key).orderBy("diag")
    near = F.col("diag") - F.lag("diag").over(w) <= GAP
    group = (diag.filter(~full).withColumn("_new", F.when(near, 0).otherwise(1))
             .withColumn("_g", F.sum("_new").over(w)))
    merged = group.groupBy(*key, "label", "phrase", "runs", "name", "_g").agg(
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
        F.min("lo").alias("first_word"))
    named = F.col("name").isNull() | F.array_contains("seen", F.col("name"))
    loose = merged.withColumn("share", F.size("seen") / F.col("runs")).filter(
        (F.col("share") >= COVERAGE) & named).select(*key, "label", "phrase", "first_word", "share")
    return exact.unionByName(loose)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its license places and labels."""
    v = stage(votes(docs), "license-votes")
    key = ["doc_id", "_key"]
    # The row without template carries every document through, once for each repeat of its row.
    blank = v.filter(F.col("tpl").isNull()).select(
        *key, "n_words", F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("boolean").alias("phrase"), F.lit(None).cast("int").alias("first_word"),
        F.lit(None).cast("double").alias("share"))
    found = spans(v).select(*key, F.lit(None).cast("long").alias("n_words"), "label", "phrase",
                            "first_word", "share")
    base = F.col("phrase")
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = blank.unionByName(found).groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("_copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        text(F.when(base, F.col("label"))).alias("base_labels"), text(F.col("label")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_i")
                      ).drop("_i", "_copies", "_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned for phrases and notices."""
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
