"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callweave.llm import (
    chat, exact_dedup, language, line_dedup, line_quality, mixing, near_dedup, negatives, packing,
    repeats, tokenbin, toxicity, whitening,
)
from callweave.llm.common import documents, run_folder

#: A conversation whose texts hold control strings, beside those of the table.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir)).drop("source")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.class_report(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_report(documents(spark, sf_dir), labels)


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(documents(spark, sf_dir))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_report(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_report(documents(spark, sf_dir))


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.chat_report(table.unionByName(extra), vocabulary("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, target = vocabulary("byte_bpe_50k.json"), run_folder(spark, "token-files")
    tokenbin.write(documents(spark, sf_dir), path, target)
    return tokenbin.read(spark, target, path)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(embeddings(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(embeddings(spark, sf_dir), F.col("id") % 100 == 0, label=label)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


QUERIES = {
    query.__name__: query
    for query in (
        op1_mix_sources, op2_near_dedup, op3_toxicity, op4_repeated_strings, op5_best_two_fit,
        op6_exact_dedup, op7_language, op8_quality_rules, op9_chat_tree, op10_token_files,
        op11_whitening, op12_hard_negatives, op13_line_dedup,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op6_exact_dedup": """
        select doc_id,
               max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, '')) as group_size,
               row_number() over (partition by coalesce(text, '')
                                  order by doc_id desc nulls last) = 1 as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents""",
    "op8_quality_rules": f"""
        with d as (
            select row_number() over () as r, doc_id, source, coalesce(text, '') as text
            from documents),
        w as (
            select *, regexp_extract_all(text, '{_WORD}') as words,
                   list_filter(string_split(text, chr(10)),
                               lambda x: regexp_matches(x, '{_WORD}')) as lines
            from d),
        grams as (
            select r, i, count(*) over (partition by r, words[i], words[i + 1], words[i + 2]) as n
            from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
        repeated as (
            select r, count(distinct i + k) as n
            from grams, (values (0), (1), (2)) as o(k) where n > 1 group by r),
        l as (
            select r, source, text, line,
                   trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g'), ' ') as plain
            from (select r, source, text, unnest(lines) as line from w)),
        frequent as (
            select source, plain from l group by source, plain having count(distinct text) > 10),
        removed as (
            select r, sum(len(regexp_extract_all(line, '{_WORD}'))) as n
            from l join frequent f
              on l.plain = f.plain and l.source is not distinct from f.source
            group by r),
        counted as (
            select w.doc_id, len(words) as n_words,
                   length(array_to_string(words, '')) as word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
                   len(lines) - len(list_distinct(lines)) as n_dup_lines,
                   coalesce(repeated.n, 0) as n_repeat_words,
                   coalesce(removed.n, 0)::bigint as words_removed
            from w left join repeated using (r) left join removed using (r)),
        judged as (
            select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
            from counted)
        select *, not base_failed and n_words - words_removed >= 50
                  and words_removed <= 0.5 * n_words as kept
        from judged""",
    "op9_chat_tree": f"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
            from conversations
            union all select -7, 0, 'user', '{CONTROL_TEXT}'
            union all select -7, 1, 'assistant', '{CONTROL_TEXT}')
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
                   as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text)
                               filter (role = 'assistant'), '')) as loss_sha256,
               sum(length('### ' || regexp_replace(role, '(\\\\|###|</turn>|:)', '\\\\\\1', 'g') || ': ')
                   + length(regexp_replace(text, '(\\\\|###|</turn>)', '\\\\\\1', 'g'))
                   + length('</turn>') + 1)::bigint as formatted_chars
        from t group by conv_id""",
    "op12_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda c: floor(256 * c::double)) as x
            from embeddings
            where label is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        s as (
            select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label,
                   list_dot_product(a.x, b.x)::bigint as score
            from v as a join v as b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        p as (
            select anchor_id, own, vec_id as positive_id, score as positive_score
            from s where label = own
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select p.anchor_id, positive_id, s.vec_id as negative_id, positive_score,
               s.score as negative_score,
               row_number() over (partition by p.anchor_id, positive_id
                                  order by s.score desc, s.vec_id) as rank
        from p join s on s.anchor_id = p.anchor_id and s.label <> p.own
             and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
        qualify rank <= 10""",
    "op13_line_dedup": r"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
        l as (
            select r, doc_id, i, lines[i] as line,
                   translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''),
                                            '[\x20\x09-\x0D]+$', ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from (select r, doc_id, lines, unnest(range(1, len(lines) + 1)) as i
                  from (select r, doc_id, string_split(text, chr(10)) as lines from d))),
        f as (select key from l where key <> '' group by key having count(distinct r) >= 10)
        select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.key is null), ''))
                   as kept_sha256
        from l left join f on l.key = f.key
        group by r, doc_id""",
}
