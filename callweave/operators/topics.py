"""Reports on topics: words, shares, explorer figures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from callweave.functions.columns import topic_bin


def top_words(topics: DataFrame, n: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """The ``n`` heaviest terms of every topic with their rank; ties by term."""
    window = Window.partitionBy(*group, "topic").orderBy(F.col("weight").desc(), "term")
    return topics.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def describe_topics(
    topics: DataFrame, n: int = 10, style: str = "weighted", group: Sequence[str] = ()
) -> DataFrame:
    """One text per topic: ``weight*term`` joined by `` + ``, or terms by ``,``."""
    best = top_words(topics, n, group)
    if style == "weighted":
        item, separator = F.concat_ws("*", F.col("weight").cast("string"), "term"), " + "
    elif style == "words":
        item, separator = F.col("term"), ","
    else:
        raise ValueError(f"unknown style: {style}")
    joined = F.expr(f"listagg(__item, '{separator}') WITHIN GROUP (ORDER BY rank)")
    return (
        best.withColumn("__item", item)
        .groupBy(*group, "topic")
        .agg(joined.alias("description"))
    )


def topic_share(
    doc_topics: DataFrame,
    owner: str = "owner_id",
    probability: str = "topic0_prob",
    low: float = 0.3,
    high: float = 0.7,
) -> DataFrame:
    """Documents per owner and topic bin, and their share of the owner's documents.

    Documents without a probability are not counted.
    """
    binned = doc_topics.filter(F.col(probability).isNotNull()).groupBy(
        owner, topic_bin(F.col(probability), low, high).alias("belong")
    )
    counts = binned.agg(F.count("*").alias("num"))
    total = F.sum("num").over(Window.partitionBy(owner))
    return counts.withColumn("total_call_num", total).withColumn(
        "proportion", F.col("num") / F.col("total_call_num")
    )


def topic_sizes(doc_topics: DataFrame, doc_lengths: DataFrame, key: str) -> DataFrame:
    """Share of the corpus per topic: ``topic, size``.

    ``doc_topics`` is long, ``key, topic, probability``; a document weighs as
    much as it has terms (``key, length``).
    """
    weighted = doc_topics.join(doc_lengths, key).groupBy("topic").agg(
        F.sum(F.col("probability") * F.col("length")).alias("__mass")
    )
    everything = F.sum("__mass").over(Window.partitionBy())
    return weighted.select("topic", (F.col("__mass") / everything).alias("size"))


def topic_term_relevance(
    topics: DataFrame, term_totals: DataFrame, sizes: DataFrame, weight: float = 0.6
) -> DataFrame:
    """Terms of each topic with frequency, relevance and saliency.

    ``topics``: ``topic, term, weight``; ``term_totals``: ``term, total``;
    ``sizes``: ``topic, size``. Relevance is ``w log p(term|topic) + (1-w) log
    lift``; saliency is the term's share times the divergence of its topic
    distribution from the topic sizes.
    """
    of_term = Window.partitionBy("term")
    sums = topics.groupBy("topic").agg(F.sum("weight").alias("__sum"))
    phi = topics.join(sums, "topic").withColumn("__phi", F.col("weight") / F.col("__sum"))
    known = topics.select("term").distinct().join(term_totals, "term")
    share = known.withColumn(
        "__share", F.col("total") / known.select(F.sum("total")).scalar()
    )
    joined = phi.join(share, "term").join(sizes, "topic")
    given_term = F.col("__phi") / F.sum("__phi").over(of_term)
    divergence = F.sum(F.col("__given") * F.log(F.col("__given") / F.col("size"))).over(of_term)
    relevance = weight * F.log("__phi") + (1 - weight) * F.log(
        F.col("__phi") / F.col("__share")
    )
    return joined.withColumn("__given", given_term).select(
        "topic",
        "term",
        F.col("total"),
        "size",
        relevance.alias("relevance"),
        (F.col("__share") * divergence).alias("saliency"),
    )


#: Topics whose distances are scaled to a map: their square is what the driver holds.
MAX_MAPPED_TOPICS = 2000


def topic_distances(topics: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence of every two topics: ``topic_a, topic_b, distance``, a < b.

    ``topics``: ``topic, term, weight``. Topics meet on the terms that both have; a term
    that only one of them has adds half its probability times log 2, so what is left of
    both sums is all that is needed of the other terms. Only positive weights count.
    """
    kept = topics.filter("weight > 0")
    sums = kept.groupBy("topic").agg(F.sum("weight").alias("__sum"))
    phi = kept.join(sums, "topic").select("topic", "term", (F.col("weight") / F.col("__sum")).alias("p"))
    one = phi.select(F.col("topic").alias("topic_a"), "term", "p")
    two = phi.select(F.col("topic").alias("topic_b"), "term", F.col("p").alias("q"))
    mean = (F.col("p") + F.col("q")) / 2
    shared = one.join(two, "term").filter("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(
        F.sum(F.col("p") * F.log(F.col("p") / mean) + F.col("q") * F.log(F.col("q") / mean)).alias("__both"),
        F.sum(F.col("p") + F.col("q")).alias("__mass"),
    )
    # Topics without a common term meet in no row of the join.
    names = sums.select("topic").agg(F.sort_array(F.collect_set("topic")).alias("names"))
    pairs = names.select(F.explode("names").alias("topic_a"), "names").select(
        "topic_a", F.explode(F.filter("names", lambda n: n > F.col("topic_a"))).alias("topic_b")
    )
    divergence = F.coalesce("__both", F.lit(0.0)) + (2 - F.coalesce("__mass", F.lit(0.0))) * F.log(F.lit(2.0))
    return pairs.join(shared, ["topic_a", "topic_b"], "left").select(
        "topic_a", "topic_b", F.greatest(divergence / 2, F.lit(0.0)).alias("distance")
    )


def scaled(distances: np.ndarray, dimensions: int = 2) -> np.ndarray:
    """Classical scaling: coordinates whose distances approach the given ones.

    The doubly centred squares are decomposed; directions come by falling eigenvalue,
    those without a positive one are 0. Of each, the largest coordinate is positive.
    """
    k = len(distances)
    centre = np.eye(k) - np.ones((k, k)) / k
    values, vectors = np.linalg.eigh(-centre @ (distances**2) @ centre / 2)
    order = np.argsort(-values, kind="stable")[:dimensions]
    found = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    found = np.where(values[order] > 1e-12 * max(abs(values).max(), 1e-300), found, 0.0)
    found = found * np.where(found[np.abs(found).argmax(axis=0), range(found.shape[1])] < 0, -1, 1)
    return np.pad(found, ((0, 0), (0, dimensions - found.shape[1])))


def topic_map(topics: DataFrame, sizes: DataFrame) -> DataFrame:
    """Where each topic stands on the map of topics: ``topic, x, y, size``.

    The distances are one row per two topics; the driver scales them, so there may be
    at most :data:`MAX_MAPPED_TOPICS` topics. One topic stands at 0, 0.
    """
    names = [r["topic"] for r in topics.filter("weight > 0").select("topic").distinct().orderBy("topic")
             .limit(MAX_MAPPED_TOPICS + 1).collect()]
    if len(names) > MAX_MAPPED_TOPICS:
        raise ValueError(f"more than {MAX_MAPPED_TOPICS} topics have no map")
    at = {name: k for k, name in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for row in topic_distances(topics).collect():
        a, b = at[row["topic_a"]], at[row["topic_b"]]
        matrix[a, b] = matrix[b, a] = row["distance"]
    places = scaled(matrix) if names else np.zeros((0, 2))
    kind = topics.schema["topic"].dataType.simpleString()
    rows = [(name, float(x), float(y)) for name, (x, y) in zip(names, places)]
    found = topics.sparkSession.createDataFrame(rows, f"topic {kind}, x double, y double")
    return found.join(sizes.select("topic", "size"), "topic", "left")
