"""From transcripts to a topic model per agent and the shares of its topics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from callweave.functions.predicates import not_self_min_duration
from callweave.functions.segmentation import segment
from callweave.functions.text import remove_stopwords, tokenize
from callweave.operators.group_topics import GroupTopics, attach_topics, fit_topics_by_group
from callweave.operators.topics import topic_share
from callweave.operators.vocabulary import term_rows


@dataclass(frozen=True)
class AgentTopics:
    """``terms``  owner_id, callid, term per occurrence
    ``calls``  the transcripts with topic probabilities and words
    ``shares`` calls per agent and topic bin
    """

    terms: DataFrame
    fitted: GroupTopics
    calls: DataFrame
    shares: DataFrame


def transcript_terms(
    transcripts: DataFrame,
    words: Sequence[str] = (),
    dictionary: Iterable[str] | DataFrame | None = None,
    stopwords: Sequence[str] = (),
    min_seconds: int = 10,
    min_length: int = 2,
    lexicon: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Transcripts with another person than the debtor that lasted, and their terms.

    Segmented by greedy longest match, or by the best path with a ``lexicon`` of
    ``word, total``; without stop words and without terms of fewer than ``min_length``
    characters.
    """
    kept = not_self_min_duration(transcripts, min_seconds)
    texts = kept.select("owner_id", "callid", "content")
    if lexicon is None:
        cut = tokenize(texts, "content", words, dictionary)
    else:
        cut = segment(texts, "content", lexicon, words)
    tokens = F.filter(
        remove_stopwords(F.transform("tokens", F.lower), stopwords),
        lambda t: F.length(t) >= min_length,
    )
    return kept, term_rows(cut, ["owner_id", "callid"], tokens)


def agent_topics(
    transcripts: DataFrame,
    words: Sequence[str] = (),
    dictionary: Iterable[str] | DataFrame | None = None,
    stopwords: Sequence[str] = (),
    k: int = 2,
    min_seconds: int = 10,
    max_features: int = 1000,
    work_dir: str | None = None,
    lexicon: DataFrame | None = None,
) -> AgentTopics:
    """One model per agent over the agent's transcripts; no kept call is lost."""
    kept, terms = transcript_terms(
        transcripts, words, dictionary, stopwords, min_seconds, lexicon=lexicon
    )
    listed = kept.select("owner_id", "callid").distinct()
    fitted = fit_topics_by_group(
        terms, "owner_id", "callid", k, max_features=max_features, documents=listed,
        work_dir=work_dir,
    )
    calls = attach_topics(kept, fitted, "owner_id", "callid")
    return AgentTopics(terms, fitted, calls, topic_share(calls))
