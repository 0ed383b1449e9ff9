"""Check SQL per registered query."""

from __future__ import annotations

from callweave.functions.rules_zh import (
    AGENT_RULES, AGENT_SEQUENCE, SHOWN_ONLY_WITH, USER_RULES, USER_SEQUENCE,
)
from callweave.operators.reports import (
    ALL_SELF_METRICS, CONTACT_METRICS, NUMERIC, SELF_METRICS,
)
from workload.bindings import BEFORE, CUTOFF, MONTH, SINCE
from workload.queries import (
    DECOMPOSED, FORCED_WORD, LATIN_RULES, LEMMAS, MODEL_LIKE, OTHER_PATTERNS, STOPWORDS,
)
from workload.sqlparts import (
    CALL_COLUMNS, METRIC_COLUMNS, quote, rule_column, trigger_rows, with_parts,
)

SPEED = "round(speed, 6) as speed"
METRIC_ROUNDS = """replace (round(collector_speed, 6) as collector_speed,
  round(receiver_speed, 6) as receiver_speed,
  round(ratio_collector_char, 6) as ratio_collector_char,
  round(jingban_mean_sentence_num, 6) as jingban_mean_sentence_num,
  round(yonghu_mean_sentence_num, 6) as yonghu_mean_sentence_num)"""


def _report(contact: str, metrics, where: str, deviation: bool, min_rows: int) -> str:
    def value(m: str) -> str:
        return m if m in NUMERIC else f"case when {m} = 'true' then 1 else 0 end"

    columns = [f"round(avg({value(m)}), 6) as {m}_mean" for m in metrics]
    if deviation:
        columns += [f"round(stddev_samp({value(m)}), 6) as {m}_std" for m in metrics]
    return (
        "select owner_id, cast(month(cast(dt as date)) as int) as month, count(*) as num, "
        + ", ".join(columns)
        + f" from lifecycle where new_contact_type = {quote(contact)} {where}"
        + f" group by 1, 2 having count(*) > {min_rows}"
    )


def _sequence(names, out: str, table: str) -> str:
    parts = " || ".join(
        f"(case when {n} is null or {n} = 'false' then '' else {n} end)" for n in names
    )
    return f"select callid, contact_type, channel, seq_id, content, {parts} as {out} from {table}"


def _flag_counts(table: str, rules) -> str:
    return " union all ".join(
        f"select '{r.name}' as flag, coalesce({r.name}, 'none') as value, count(*) as num "
        f"from {table} group by 2"
        for r in rules
    )


_STOP = ", ".join(quote(w) for w in STOPWORDS)
_LEMMA = "case " + " ".join(
    f"when w = {quote(a)} then {quote(b)}" for a, b in LEMMAS.items()
) + " else w end"

#: Text parts. The accent rule of DuckDB agrees on the letters of the documents.
TEXT = {
    "doc_terms": rf"""select * from (select source as owner_id, lang, doc_id,
  unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]{{2,}}', 0)) as term
from documents) where term not in ({_STOP})""",
    "corpus_terms": "select term, count(*) as total from doc_terms group by 1",
    "top_terms": "select * from corpus_terms order by total desc, term limit 1000",
    "owner_terms": """select *, row_number() over (partition by owner_id order by total desc, term)
  as rn from (select owner_id, term, count(*) as total from doc_terms group by 1, 2)""",
    "lang_weights": """select lang as topic, term, cast(count(*) as double) as weight
from doc_terms group by 1, 2""",
    "ranked_words": """select *, cast(row_number() over (partition by topic order by weight desc,
  term) as int) as rank from lang_weights""",
    "topic_size": """select lang as topic,
  count(*) / (select count(*) from doc_terms) as size from doc_terms group by 1""",
    "english_terms": rf"""select doc_id, unnest(list_transform(list_filter(
  regexp_split_to_array(regexp_replace(array_to_string(list_filter(
    regexp_split_to_array(regexp_replace(lower(text), '^ +| +$', '', 'g'), '\s+'),
    lambda w: w not in ({_STOP})), ' '), '[[:punct:]]', '', 'g'), '\s+'),
  lambda w: w <> ''), lambda w: {_LEMMA})) as term
from documents where lang = 'en'""",
    "kept_transcripts": """select * from transcripts
where phone_type is distinct from 'self' and duration >= 10""",
    "transcript_words": rf"""select owner_id, unnest(list_filter(list_transform(
  regexp_extract_all(content, '打个电话|打电话|征信|[\x{{4e00}}-\x{{9fa5}}]|[\p{{Latin}}\p{{M}}\p{{N}}_]+', 0),
  lambda w: lower(w)), lambda w: length(w) >= 2 and w not in ({_STOP}))) as term
from kept_transcripts""",
    "probabilities": """select doc_id, source as owner_id,
  case when n_chars % 19 <> 0 then (n_chars % 101) / 100.0::double end as topic0_prob
from documents""",
}

_BIN = "case when topic0_prob <= 0.3 then 1 when topic0_prob >= 0.7 then 0 else 2 end"

_LATIN_TRIGGER = LATIN_RULES[3].after

SQL: dict[str, str] = {
    "s1_read_table": "select event_id, user_id, event_type from events",
    "s2_read_agent_calls": "select * from transcripts where owner_id in (1, 3, 5, 7)",
    "s2_owners_of_a_table": "select * from transcripts where owner_id in (1, 3, 5, 7)",
    "s5_bucketed_metrics": f"select * {METRIC_ROUNDS} from call_metrics",
    "s5_changed_dates": """select file_date, owner_id, count(*) as n_calls,
  cast(sum(duration) as bigint) as seconds from event_calls group by 1, 2""",
    "j5_relation_by_day": """select callid, order_id from event_calls a left join
  (select user_id, phone, dt, min(order_id) as order_id from directory group by 1, 2, 3) b
  on a.user_id = b.user_id and a.phone = b.phone and cast(a.ringtime as date) = b.dt
where file_date < '2024-01-11'""",
    "s3_read_words": "select trim(p_name) as word from part",
    "s5_materialize": "select * from event_calls_allocated",
    "s6_export_by_owner": "select * from transcripts",
    "s7_write_report": """select owner_id, tot_case_num, round(repay_rate, 6) as repay_rate
from agents""",
    "p1_projection": f"""select {METRIC_COLUMNS.replace("dt,", "dt as call_date,", 1)}
from event_features""",
    "p2_in_month": """select callid, file_date from event_calls
where substr(file_date, 1, 7) = '2024-01'""",
    "p3_in_window": """select dun_case_id, time_mark from allocations
where cast(time_mark as date) >= date '2024-01-08' and cast(time_mark as date) < date '2024-01-20'""",
    "p4_number_between": """select * from allocations
where overdue_max_days >= 31 and overdue_max_days <= 60""",
    "p5_text_contains": "select p_partkey, p_type from part where p_type like '%PRO%'",
    "p6_not_null": """select calluuid, try_cast(ud_2 as int) as "case" from sip_records
where try_cast(ud_2 as int) is not null""",
    "p7_split_era": f"""select callid, case when file_date <= '{CUTOFF}' then 'early'
  when file_date <= '2024-01-31' then 'late' else 'beyond' end as era from event_calls""",
    "p8_by_channel": "select callid, seq_id from turns where channel = 'USER'",
    "p9_not_self_min_duration": """select callid, phone_type, duration from event_calls_plus
where phone_type is distinct from 'self' and duration >= 10""",
    "p10_min_duration": "select callid, duration from event_calls where duration > 10",
    "p11_first_contact_calls": f"""select callid, dt, yes_call_num, day_num from event_features
where duration >= 10 and ((dt <= '{CUTOFF}' and is_first_yes_call = '新案' and yes_call_num = 1
  and day_num = 0) or (dt > '{CUTOFF}' and yes_call_num = 1))""",
    "j1_attach_speed": f"""select a.callid, a.channel, new_name, content, file_date, {SPEED}
from merged a left join speeds b on a.callid = b.callid and a.channel = b.channel""",
    "j2_attach_call": """select distinct a.callid, a.file_date, b.dnis as phone, b.ringtime,
  b.t_durtion as duration, b.user_id, b.owner_id, b.owner_name, b.group_name
from turns a left join call_records b on a.callid = b.calluuid where b.user_id is not null""",
    "j3_asof_allocation": """select * exclude (rn) from (
  select a.*, c.time_mark, c.dun_case_id as allocated_case,
    row_number() over (partition by callid, user_id order by c.time_mark desc, c.dun_case_id desc)
      as rn
  from event_calls a join candidates c on a.user_id = c.borrow_user_id
    and cast(c.time_mark as date) <= cast(a.ringtime as date)) where rn = 1""",
    "j4_resolve_agent": "select * from agent_of_call",
    "j5_attach_relation": """select callid, order_id from event_calls a left join
  (select user_id, phone, dt, min(order_id) as order_id from directory group by 1, 2, 3) b
  on a.user_id = b.user_id and a.phone = b.phone and cast(a.ringtime as date) = b.dt""",
    "j6_attach_call_attributes": """select t.callid, t.seq_id, c.file_date as dt, c.owner_id,
  c.phone_type as contact_type from turns t left join calls_plus c on t.callid = c.callid""",
    "j7_after_turn": "select b.callid, b.seq_id, b.channel from turns b join "
    + f"({trigger_rows(AGENT_RULES[9].after)}) r on r.callid = b.callid and r.seq_id = b.seq_id",
    "j8_merge_call_flags": """select u.owner_id, u.dt, u.callid, u.contact_type, u.is_helping,
  u.is_detail, a.mention_address, a.is_knowing
from agent_calls a left join user_calls u on a.callid = u.callid where u.callid is not null""",
    "j10_from_first_contact": f"""select a.callid, a.dun_case_id, a.ringtime from event_features a
join case_base b on a.dun_case_id = b.dun_case_id and a.ringtime >= b.base
where a.dt <= '{CUTOFF}'""",
    "j11_only_unique": """select calluuid, user_id, owner_id from call_records
where calluuid not in (select calluuid from call_records group by 1 having count(*) > 1)""",
    "j13_calls_with_rank": """select a.callid, a.owner_id, r.jx_rank
from event_calls a left join ranked r on a.owner_id = r.owner_id""",
    "j14_only_agents": """select owner_id, dun_case_id from performance where owner_id in (
  select owner_id from (select owner_id,
    row_number() over (order by repay_rate desc nulls last, owner_id) as best,
    row_number() over (order by repay_rate asc nulls last, owner_id desc) as worst from agents)
  where best <= 10 or worst <= 10)""",
    "a1_merge_segments": "select * from merged",
    "a2_call_text": f"""select file_date, callid, channel,
  string_agg(content, ', ' order by seq_id) as content
from turns where substr(file_date, 1, 7) = '{MONTH}' group by 1, 2, 3""",
    "a3_call_text_all": f"""select * from (select b.owner_id, a.file_date, a.callid, a.channel,
  string_agg(a.content, ', ' order by a.seq_id) as content
from turns a left join calls b on a.callid = b.callid where a.channel = 'AGENT'
group by 1, 2, 3, 4) where substr(file_date, 1, 7) = '{MONTH}'""",
    "a4_weighted_speed": f"select callid, channel, file_date, {SPEED} from speeds",
    "a5_closest_relation": """select user_id, phone, dt, min(order_id) as order_id
from directory group by 1, 2, 3""",
    "a6_case_base": "select * from case_base",
    "a7_rollup_flags": "select * from user_calls",
    "a8_blank_unless": "select callid, "
    + ", ".join(
        f"case when {w} = 'false' or {w} is null then null else {n} end as {n}"
        for n, w in SHOWN_ONLY_WITH.items()
    )
    + " from event_features",
    "a11_agent_performance": """select owner_id, tot_case_num, round(repay_rate, 6) as repay_rate
from agents""",
    "a12_lifecycle_histogram": """select day_num, num, count(num) as num_num from (
  select owner_id, dun_case_id, time_mark, max(day_num) as day_num, count(*) as num
  from complete_calls where time_mark < date '2024-01-28' group by 1, 2, 3) group by 1, 2""",
    "a12_lifecycle_histogram_self": """select day_num, num, count(num) as num_num from (
  select owner_id, dun_case_id, time_mark, max(day_num) as day_num, count(*) as num
  from complete_self_calls where time_mark < date '2024-01-28' and contact_type = 'self'
  group by 1, 2, 3) group by 1, 2""",
    "a13_first_contact_report": _report("联系人", CONTACT_METRICS, "and order_num = 1", True, 50),
    "a13_first_self_report": _report("逾期本人", SELF_METRICS, "and order_num = 1", True, 5),
    "a13_all_self_report": _report("逾期本人", ALL_SELF_METRICS, "", False, 5),
    "a14_documents_per_agent": """select source as owner_id, count(*) as num
from documents group by 1""",
    "w1_number_turns": """select new_name, callid, channel, cast(row_number() over (
  partition by callid order by try_cast(split_part(new_name, '_', 3) as int) nulls first,
  new_name, channel) as int) as seq_id from merged""",
    "w2_latest_per_call": "select * from event_calls_allocated",
    "w3_balanced_ordinal": "select callid, user_id, time_mark, yes_call_num from event_calls_plus",
    "w4_balanced_order": "select callid, new_contact_type, order_num from lifecycle",
    "w3_call_ordinal": "select callid, user_id, time_mark, yes_call_num from event_calls_plus",
    "w4_contact_order": "select callid, new_contact_type, order_num from lifecycle",
    "w5_rank_agents": "select * replace (round(repay_rate, 6) as repay_rate) from ranked",
    "k1_top_bottom": """select owner_id, tot_case_num, round(repay_rate, 6) as repay_rate from (
  select *, row_number() over (order by repay_rate desc nulls last, owner_id) as best,
    row_number() over (order by repay_rate asc nulls last, owner_id desc) as worst from agents)
where best <= 10 or worst <= 10""",
    "k2_sorted_extract": """select b.owner_id, a.file_date, a.callid, a.channel,
  string_agg(a.content, ', ' order by a.seq_id) as content
from turns a left join calls b on a.callid = b.callid where a.channel = 'AGENT'
group by 1, 2, 3, 4 order by 1, 2, 3, 4""",
    "k3_top_words": "select * from ranked_words where rank <= 10",
    "k4_first_agent": """select owner_id, callid from event_calls
where owner_id = (select min(owner_id) from event_calls)""",
    "u1_union_eras": f"""select {CALL_COLUMNS} from event_calls_allocated
where file_date <= '2024-01-20'
union select {CALL_COLUMNS} from event_calls_allocated where file_date > '{CUTOFF}'""",
    "u2_complete_calls": "select * from complete_calls",
    "u3_append": """select owner_id, callid from event_calls
where owner_id = (select min(owner_id) from event_calls)
union all select owner_id, callid from event_calls""",
    "f_scalars": r"""select new_name, cast(seg_no as int) as seg_no, try_cast(split_part(new_name, '_', 3) as int)
  as turn_number, try_cast(split_part(rt_text, '_', 1) as int) as no_number,
  cast(strlen(rt_text) as int) as bytes, strlen(rt_text) // 3 as chars_of_three,
  cast(length(rt_text) as int) as chars,
  substr(rt_text, 1, 7) as head, rt_text like '%电话%' as has_phone,
  regexp_matches(rt_text, '[0-9]|你') as has_you,
  regexp_replace(lower(rt_text), '[[:punct:]]', '', 'g') as bare from segments""",
    "f_case_columns": """select callid,
  case when owner_id in (1, 2) then 'self' when owner_id in (3, 4, 5) then 'close_contact'
       when owner_id in (6, 7) then 'top_contact' else 'others' end as relation,
  case when time_mark = cast(ringtime as date) then '新案' else '老案' end as age,
  case when phone_type = 'self' then '逾期本人' else '联系人' end as contact,
  cast(month(ringtime) as int) as ring_month,
  cast(date_diff('day', time_mark, cast(ringtime as date)) as int) as days,
  concat(cast(cast(duration / 128 * 100 as decimal(38, 2)) as varchar), '%') as percent,
  case when duration > 50 then 1 else 0 end as long_call from event_calls_plus""",
    "f13_topic_bin": f"select doc_id, topic0_prob, {_BIN} as belong from probabilities",
    "f15_agent_sequences": _sequence(AGENT_SEQUENCE, "jingban_pattern", "agent_flags"),
    "f15_user_sequences": _sequence(USER_SEQUENCE, "yonghu_pattern", "user_flags"),
    "r0_tag_turns": "select callid, seq_id, "
    + ", ".join(rule_column(r) for r in LATIN_RULES)
    + " from (select t.*, asked_long, cast(null as varchar) as contact_type from turns t left join ("
    + f"""select b.callid, b.seq_id, (a.channel = '{_LATIN_TRIGGER.channel}'
  and regexp_matches(a.content, {quote(_LATIN_TRIGGER.any_of[0])})) or null as asked_long
  from turns a join turns b on a.callid = b.callid and a.seq_id = b.seq_id - 1) using (callid, seq_id))""",
    "r0_rule_counts": _flag_counts("agent_flags", AGENT_RULES)
    + " union all "
    + _flag_counts("user_flags", USER_RULES),
    "c1_build_turns": f"select * replace ({SPEED}) from turns",
    "c2_build_calls": "select * from calls",
    "c3_enrich_calls": "select * from calls_plus",
    "c3_enrich_event_calls": "select * from event_calls_plus",
    "c4_agent_flags": f"select * replace ({SPEED}) from agent_flags",
    "c4_user_flags": f"select * replace ({SPEED}) from user_flags",
    "c5_call_flags": "select * from call_flags",
    "c6_call_metrics": f"select * {METRIC_ROUNDS} from call_metrics",
    "c7_call_features": f"select * {METRIC_ROUNDS} from features",
    "c7_call_features_stepwise": f"select * {METRIC_ROUNDS} from features",
    "c8_lifecycle_base": "select * from lifecycle",
    "c9_extract_transcripts": "select * from transcripts",
    "c10_duplicate_keys": """select calluuid, count(*) as copies from call_records
group by 1 having count(*) > 1""",
    "c10_duplicate_directory": """select user_id, phone, dt, count(*) as copies from directory
group by 1, 2, 3 having count(*) > 1""",
    "c10_unmatched": """select callid, user_id from event_calls a where not exists (
  select 1 from event_calls_allocated b where a.callid = b.callid and a.user_id = b.user_id)""",
    "t1_tokenize": r"""select callid, seq_id, cast(len(tokens) as int) as n_tokens,
  array_to_string(tokens, ' ') as cut_words
from (select callid, seq_id, regexp_extract_all(content,
  '紧急联系人|打个电话|打电话|征信|[\x{4e00}-\x{9fa5}]|[\p{Latin}\p{M}\p{N}_]+', 0) as tokens from turns)""",
    "t1_tokenize_documents": r"""select doc_id, cast(len(regexp_extract_all(text,
  '打个电话|打电话|[\x{4e00}-\x{9fa5}]|[\p{L}\p{M}\p{N}_]+', 0)) as int) as n_tokens from documents""",
    "t1_tokenize_lexicon": r"""select doc_id, cast(len(tokens) as int) as n_tokens,
  array_to_string(tokens, ' ') as cut_words
from (select doc_id, regexp_extract_all(lower(text), 'oredthe|' || (
        select string_agg(word, '|' order by length(word) desc, word) from (
          select word, count(*) as n
          from (select unnest(string_split(lower(text), ' ')) as word from documents)
          where regexp_full_match(word, '[a-z]{2,4}') group by 1) where n >= 20)
      || '|[\x{4e00}-\x{9fa5}]|[\p{L}\p{M}\p{N}_]+', 0) as tokens
  from documents)""",
    "t1_best_path": f"""select p_partkey, cast(len(tokens) as int) as n_tokens,
  array_to_string(tokens, ' ') as cut_words
from (
  with recursive
  lex0 as (select word, count(*) as total
           from (select unnest([w, w[1:3], right(w, 4)]) as word
                 from (select unnest(string_split(p_name, ' ')) as w from part)) group by 1),
  lex as (select word, cast(round(1000000 * ln(total / (select cast(sum(total) as double) from lex0)))
                            as bigint) as weight from lex0
          union all
          select null, cast(round(1000000 * ln(1 / (select cast(sum(total) as double) from lex0)))
                            as bigint)),
  pieces as (select p_partkey, unnest(found) as piece, unnest(range(len(found))) as pos
             from (select p_partkey, string_split(replace(replace(p_name, ' ', ''),
                     '{FORCED_WORD}', '#{FORCED_WORD}#'), '#') as found from part)),
  paths as (
    select distinct piece, 0 as pos, cast(0 as bigint) as score, cast([] as varchar[]) as tokens
    from pieces where piece <> '' and piece <> '{FORCED_WORD}'
    union all
    select p.piece, p.pos + length(coalesce(l.word, substr(p.piece, p.pos + 1))), p.score + l.weight,
      list_append(p.tokens, coalesce(l.word, substr(p.piece, p.pos + 1)))
    from paths p join lex l
      on l.word is null or starts_with(substr(p.piece, p.pos + 1), l.word)
    where p.pos < length(p.piece)),
  best as (
    select piece, tokens from paths where pos = length(piece)
    qualify row_number() over (partition by piece
      order by score desc, list_transform(tokens, lambda w: length(w)) desc) = 1)
  select p_partkey, flatten(list(case when p.piece = '{FORCED_WORD}' then [p.piece] else b.tokens end
                                 order by p.pos)) as tokens
  from pieces p left join best b on p.piece = b.piece where p.piece <> '' group by 1)""",
    "l1_online_one_topic": """select cast(0 as int) as topic, term,
  round(cast(total + 1 as double), 6) as weight
from (select term, count(*) as total from english_terms group by 1
      order by total desc, term limit 1000)""",
    "l1_bound_rises": "select cast(6 as int) as n_steps, true as rises",
    "l2_settled_weight_sums": """select owner_id, 2 * count(*) as n_weights,
  round(cast(count(*) + sum(total) as double), 3) as total_weight
from owner_terms where rn <= 1000 group by 1""",
    "l6_topic_distances": """select topic_a, topic_b, round((
    sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end)
    + sum(case when q > 0 then q * ln(2 * q / (p + q)) else 0 end)) / 2, 6) as distance
from (select a.topic as topic_a, b.topic as topic_b, t.term, coalesce(x.phi, 0) as p,
        coalesce(y.phi, 0) as q
      from (select distinct topic from lang_weights) a
      join (select distinct topic from lang_weights) b on a.topic < b.topic
      join (select distinct term from lang_weights) t on true
      left join (select topic, term, weight / sum(weight) over (partition by topic) as phi
                 from lang_weights) x on x.topic = a.topic and x.term = t.term
      left join (select topic, term, weight / sum(weight) over (partition by topic) as phi
                 from lang_weights) y on y.topic = b.topic and y.term = t.term)
where p > 0 or q > 0 group by 1, 2""",
    "r0_other_patterns": "select conv_id, turn, " + ", ".join(
        f"regexp_matches(text, {quote(p)}) as p{i}" for i, p in enumerate(OTHER_PATTERNS)
    ) + ", " + " or ".join(f"regexp_matches(text, {quote(p)})" for p in OTHER_PATTERNS[1:4])
    + " as any_of from conversations",
    "t4_other_characters": f"""select p_partkey, p_name
  || list_extract([{", ".join(quote(base) for _, base in DECOMPOSED)}],
    cast(p_partkey % {len(DECOMPOSED)} as int) + 1) || ' E' as plain from part""",
    "l2_topic_plan": """select owner_id, n_calls, coalesce(n_terms, 0) as n_terms,
  coalesce(n_known, 0) as n_known, n_calls as n_binned
from (select owner_id, count(*) as n_calls from kept_transcripts group by 1)
left join (select owner_id, count(*) as n_terms, least(count(distinct term), 1000) as n_known
           from transcript_words group by 1) using (owner_id)""",
    "t2_clean_english": rf"""select doc_id, array_to_string(list_transform(list_filter(
  regexp_split_to_array(regexp_replace(array_to_string(list_filter(
    regexp_split_to_array(regexp_replace(lower(text), '^ +| +$', '', 'g'), '\s+'),
    lambda w: w not in ({_STOP})), ' '), '[[:punct:]]', '', 'g'), '\s+'),
  lambda w: w <> ''), lambda w: {_LEMMA}), ' ') as clean
from documents where lang = 'en'""",
    "t2_lemmatize": """select regexp_replace(term, '(er|et|ng)$', '') as term, count(*) as num
from (select unnest(string_split(p_name, ' ')) as term from part) group by 1""",
    "t3_remove_stopwords": f"""select doc_id, array_to_string(list_filter(
  string_split(lower(text), ' '), lambda w: w not in ({_STOP})), ' ') as kept from documents""",
    "t4_strip_accents": "select doc_id, strip_accents(text) as plain from documents",
    "t4_strip_accents_full": "select doc_id, strip_accents(text) as plain from documents",
    "t5_vocabulary": "select * from top_terms",
    "t5_frequent_terms": "select * from top_terms order by total desc, term limit 200",
    "t5_vocabulary_by_agent": "select owner_id, term, total from owner_terms where rn <= 1000",
    "t6_doc_term_counts": """select doc_id, term, count(*) as cnt from doc_terms
where term in (select term from top_terms) group by 1, 2""",
    "t6_doc_term_counts_by_agent": """select d.owner_id, d.doc_id, d.term, count(*) as cnt
from doc_terms d join owner_terms o on d.owner_id = o.owner_id and d.term = o.term
where o.rn <= 1000 group by 1, 2, 3""",
    "l1_weight_sums": """select 5 * count(*) as n_weights,
  round(cast(count(*) + sum(total) as double), 3) as total_weight from top_terms""",
    "l1_one_topic": """select cast(0 as int) as topic, term, round(cast(total + 1 as double), 6) as weight
from top_terms""",
    "l1_english_topics": """select 3 * count(*) as n_weights,
  round(cast(count(*) + sum(total) as double), 3) as total_weight
from (select term, count(*) as total from english_terms group by 1
      order by total desc, term limit 1000)""",
    "l2_weight_sums": """select owner_id, 2 * count(*) as n_weights,
  round(cast(count(*) + sum(total) as double), 3) as total_weight
from owner_terms where rn <= 1000 group by 1""",
    "l3_probability_sums": "select doc_id, cast(1 as double) as total from documents",
    "l4_describe_one_topic": """select cast(0 as int) as topic,
  string_agg((total + 1) || '.0*' || term, ' + ' order by total desc, term) as description
from (select * from top_terms order by total desc, term limit 12)""",
    "l6_model_relevance": """select cast(0 as int) as topic, term, total,
  cast(1 as double) as size,
  round(0.6 * ln(phi) + (1 - 0.6) * ln(phi / share), 6) as relevance,
  cast(0 as double) as saliency
from (select *, (total + 1) / sum(total + 1) over () as phi, total / sum(total) over () as share
      from top_terms)""",
    "l4_describe_given_topics": """select topic, string_agg(term, ',' order by rank) as description
from ranked_words where rank <= 10 group by 1""",
    "l5_topic_share": f"""select owner_id, belong, num, total_call_num,
  round(num / total_call_num, 6) as proportion
from (select owner_id, {_BIN} as belong, count(topic0_prob) as num from probabilities
      where topic0_prob is not null group by 1, 2)
join (select owner_id, count(topic0_prob) as total_call_num from probabilities group by 1)
  using (owner_id)""",
    "l6_topic_term_relevance": """select topic, term, total, round(size, 6) as size,
  round(0.6 * ln(phi) + (1 - 0.6) * ln(phi / share), 6) as relevance,
  round(share * sum(given * ln(given / size)) over (partition by term), 6) as saliency
from (select w.topic, w.term, c.total, s.size, w.phi,
        c.total / (select cast(sum(total) as bigint) from corpus_terms) as share,
        w.phi / sum(w.phi) over (partition by w.term) as given
      from (select topic, term, weight / sum(weight) over (partition by topic) as phi
            from lang_weights) w
      join corpus_terms c on w.term = c.term join topic_size s on w.topic = s.topic)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_parts(sql, TEXT) for name, sql in SQL.items()}
