from functools import reduce
from operator import or_

import random
import re

import pytest
from pyspark.sql import functions as F

from callweave.functions.patterns import (
    alternatives, first_characters, needed_words, one_scan, plain_words,
)
from callweave.functions.rules import Rule, Trigger, occurs, with_trigger_speaker
from callweave.functions.rules_zh import (
    AGENT_RULES, AGENT_SEQUENCE, MANDARIN, TIME_PHRASES, USER_RULES, USER_SEQUENCE,
)
from callweave.operators import flags as f
from conftest import tuples

TURN = "callid string, seq_id int, channel string, content string"

# flag: (text that carries it, text that does not)
AGENT_GOLDEN = {
    "mention_repayment_time": ("请你明天处理", "请你处理"),
    "mention_owing_amount": ("你的欠款一共五百块", "你的欠款是几百块"),
    "mention_default_days": ("逾期十天", "逾期到明天"),
    "persuasion_money_loss": ("罚息一直涨，由你承担", "一直涨，由你承担"),
    "persuasion_credit_loss": ("征信有记录，上传互联网", "有记录，上传互联网"),
    "persuasion_contact": ("亲友看笑话，搞得没面子", "看笑话，搞得没面子"),
    "persuasion_law": ("法律程序会核实户籍", "会核实户籍"),
    "persuasion_crime": ("这是诈骗", "这是误会"),
    "check_last_phone": ("之前给你的电话。", "给你的电话"),
    "is_argue": ("你昨天答应了的。", "他昨天同意了的。"),
    "is_debtor_nearby": ("他在不在。", "他人呢。"),
    "is_knowing": ("您认识他吗。", "您是哪位。"),
    "is_askrelation": ("你是他同事吗。", "您是哪位。"),
    "check_other_call": ("我昨天打了电话。", "我昨天睡觉。"),
    "mention_address": ("江苏省苏州市吴江区。", "江苏省。"),
    "mention_number": ("号码是幺三五。", "号码是啥。"),
    "is_provpmorigin": ("本人留下的资料", "本人的资料"),
    "mention_photo": ("照片和身份证", "照片不清楚"),
}
USER_GOLDEN = {
    "is_askingmethod": ("我怎么还。", "我怎么说。"),
    "is_rejection": ("我就是不还", "我会处理"),
    "mention_nocall": ("不要打我电话了。", "可以打我电话。"),
    "is_complaint": ("我会去投诉你。", "他会去投诉你。"),
    "is_notknowing": ("我不认识他。", "我认识他。"),
    "mention_noconnection": ("打错了", "打对了"),
    "is_askingreduction": ("可以减少点吗。", "可以快点吗。"),
    "time_bargain": ("下个月发工资还", "我没有"),
    "is_helping": ("我试试看。", "我看看。"),
    "is_investigation": ("为什么还没解决", "还没解决"),
    "is_detail": ("我还剩多少。", "我还剩一点。"),
}


def tag_one(spark, texts, rules, channel, contact=None):
    rows = [(str(i), 1, channel, text) for i, text in enumerate(texts)]
    turns = spark.createDataFrame(rows, TURN).withColumn(
        "contact", F.lit(contact).cast("string")
    )
    return f.tag_turns(turns, rules, "contact").orderBy("callid").collect()


def test_every_flag_has_a_positive_and_a_negative(spark):
    for golden, rules, channel, contact in (
        (AGENT_GOLDEN, AGENT_RULES, "AGENT", "others"),
        (USER_GOLDEN, USER_RULES, "USER", None),
    ):
        plain = [r for r in rules if not r.after]
        assert {r.name for r in plain} == set(golden)
        texts = [t for pair in golden.values() for t in pair]
        rows = {r.content: r for r in tag_one(spark, texts, plain, channel, contact)}
        for rule in plain:
            hit, miss = golden[rule.name]
            assert rows[hit][rule.name] == rule.code, (rule.name, hit)
            assert rows[miss][rule.name] == "false", (rule.name, miss)


def test_speaker_rules_need_their_speaker(spark):
    [row] = tag_one(spark, [AGENT_GOLDEN["is_argue"][0]], AGENT_RULES[:11], "USER")
    assert row.is_argue == "false"
    [row] = tag_one(spark, [USER_GOLDEN["is_complaint"][0]], USER_RULES, "AGENT")
    assert row.is_complaint == "false"


def test_score_is_exact_at_the_threshold(spark):
    rule = [r for r in AGENT_RULES if r.name == "persuasion_money_loss"]
    at_threshold, above, no_gate = "利息每天都要承担", "利息每天都要承担，别拖", "每天都要承担，别拖"
    rows = tag_one(spark, [at_threshold, above, no_gate], rule, "AGENT")
    assert [r.persuasion_money_loss for r in rows] == ["false", "B", "false"]


@pytest.mark.parametrize(
    "flag,text,values",
    [
        ("is_debtor_nearby", "他在不在。", {"self": None, "others": "G", None: "G"}),
        ("is_notknowing", "不认识。", {"self": None, "others": "4", None: "4"}),
        ("is_askingreduction", "减免。", {"self": "1", "others": None, None: "1"}),
        ("time_bargain", "下午", {"self": "3", "others": None, None: "3"}),
    ],
)
def test_flags_not_meant_for_a_contact_are_null(spark, flag, text, values):
    rule = [r for r in (*AGENT_RULES, *USER_RULES) if r.name == flag]
    channel = "AGENT" if rule[0] in AGENT_RULES else "USER"
    for contact, expected in values.items():
        [row] = tag_one(spark, [text], rule, channel, contact)
        assert row[flag] == expected, contact


def test_missing_text_is_false(spark):
    rows = tag_one(spark, [None], [r for r in AGENT_RULES if not r.after], "AGENT")
    assert rows[0].mention_photo == "false" and rows[0].persuasion_law == "false"


def look_back(spark, rows, rules):
    turns = spark.createDataFrame(rows, TURN)
    tagged = f.tag_turns(turns, rules)
    return tuples(tagged.filter("channel = 'AGENT'"), "seq_id", *[r.name for r in rules])


def test_reactions_need_a_denial_in_the_turn_before(spark):
    reaction = [r for r in AGENT_RULES if r.name == "reaction_notknowing_anfu"]
    rows = [("1", 1, "USER", "我不认识他"), ("1", 2, "AGENT", "您放心。"),
            ("1", 3, "AGENT", "您放心。"), ("1", 4, "USER", "打错了"), ("1", 5, "AGENT", "哦。")]
    assert look_back(spark, rows, reaction) == [(2, "J"), (3, None), (5, "false")]


def test_refusal_follows_an_agent_turn_unless_told_otherwise(spark):
    refusal = [r for r in AGENT_RULES if r.name == "is_refusal_time_bargain"]
    rows = [("1", 1, "AGENT", "明天上午"), ("1", 2, "AGENT", "不行"), ("1", 3, "USER", "下周"),
            ("1", 4, "AGENT", "不行")]
    assert look_back(spark, rows, refusal) == [(1, None), (2, "D"), (4, None)]
    meant = with_trigger_speaker(refusal, "is_refusal_time_bargain", "USER")
    assert look_back(spark, rows, meant) == [(1, None), (2, None), (4, "D")]


def random_texts(patterns, n, seed):
    """Texts made of the patterns' own words and single characters."""
    rng = random.Random(seed)
    words = sorted({w for p in patterns for w in re.findall(r"[一-龥]+", p)})
    chars = sorted({ch for w in words for ch in w}) + list("，。！？a\n")
    return [
        "".join(rng.choice(words if rng.random() < 0.6 else chars) for _ in range(rng.randint(1, 7)))
        for _ in range(n)
    ]


def test_one_scan_matches_the_same_texts(spark):
    groups = [r.any_of for r in (*AGENT_RULES, *USER_RULES) if r.any_of]
    groups += [(r.gate,) for r in AGENT_RULES if r.gate]
    groups += [(p,) for r in AGENT_RULES for _, p in r.cues]
    everything = [p for g in groups for p in g]
    texts = random_texts(everything, 3000, 11)
    texts += [t for pair in (*AGENT_GOLDEN.values(), *USER_GOLDEN.values()) for t in pair]
    df = spark.createDataFrame([(t,) for t in texts], "content string").repartition(8)
    content = F.col("content")
    differing = []
    for patterns in groups:
        plain = F.lit(False)
        for p in patterns:
            plain = plain | content.rlike(p)
        differing.append(F.count_if(plain != content.rlike(one_scan(patterns))))
        differing.append(F.count_if(plain != occurs(content, *patterns)))
    hits = [F.count_if(content.rlike(one_scan(g))) for g in groups]
    row = df.agg(*differing, *hits).first()
    assert sum(row[: len(differing)]) == 0
    assert sum(n > 0 for n in row[len(differing):]) > 0.9 * len(groups)


def test_pattern_helpers():
    assert alternatives(r"a|b(c|d)|[e|f]|\|") == ["a", "b(c|d)", "[e|f]", r"\|"]
    assert first_characters("(a|bc)?d+") == {"a", "b", "d"}
    assert first_characters("[^a]b") is None
    assert first_characters("a*") is None
    assert first_characters(r"[\x{4e00}-\x{9fa5}]") is None
    assert one_scan(("^.*ab.*",)) == "^.*(?=[a])ab"
    assert needed_words(("x?(ab|cd)[^e]*(f|gh)?", "ab+c")) == ["a", "cd"]
    assert needed_words(("ab", "[^x]*")) is None
    assert plain_words(("ab|c.",)) == (["ab"], ("c.",))


def test_sequences(spark):
    turns = spark.createDataFrame(
        [("1", 1, "AGENT", "今天还五百元，逾期十天"), ("1", 2, "USER", "我会投诉。不认识。")], TURN
    ).withColumns({"contact_type": F.lit(None).cast("string")})
    tagged = f.tag_turns(turns, [*AGENT_RULES, *USER_RULES])
    agent = f.flag_sequences(tagged.filter("channel = 'AGENT'"), AGENT_SEQUENCE, "p")
    user = f.flag_sequences(tagged.filter("channel = 'USER'"), USER_SEQUENCE, "p")
    assert tuples(agent, "p") == [("AAA",)]
    assert tuples(user, "p") == [("46true",)]


def test_rule_set_shape():
    assert (len(MANDARIN.agent), len(MANDARIN.user), len(TIME_PHRASES)) == (23, 11, 18)
    assert len(set(MANDARIN.names)) == 34
    assert [t.name for t in MANDARIN.triggers] == ["time_asked", "knowing_denied"]


def test_own_rule_table(spark):
    rules = [
        Rule("greets", "G", any_of=("hello|good day",)),
        Rule("answers", after=Trigger("asked", "USER", ("[?]",)), any_of=(".",)),
    ]
    rows = [("1", 1, "USER", "hello, who?"), ("1", 2, "AGENT", "good day")]
    tagged = f.tag_turns(spark.createDataFrame(rows, TURN), rules)
    assert tuples(tagged, "seq_id", "greets", "answers") == [(1, "G", None), (2, "G", "true")]
    assert f.tag_turns(spark.createDataFrame(rows, TURN), rules, codes=False).schema[
        "greets"
    ].dataType.typeName() == "boolean"


OTHER = (
    "(?i)refund", "(?i)yes|no", r"(ab)\1|(cd)\2", r"(ab)\1|x(cd)\2", "[a-z&&[^b]]", "[a-z&&[^b]]x",
    r"no.*|yes\.*", r"wait\.*", r"\Qa.b\E|c", "a||b", "|x", "(|a)b", "(?:a|)c", "(?=x)y|xy", "(?<!a)b",
    "(?<w>ab)\\k<w>", "a.*", ".*", "^.*b", "^.*?b", "(，|。|！|？)?[^，。！？]*?x", "[[a-c]d]", "[]a]x",
    "[^]a]x", "[a-c[x-z]]", r"\p{L}\p{N}", r"\d\s", r"\bno\b", "a{2}", "a{2,}b", "a+?b", "a*+b", "(?s)a.b",
    "(?m)^x", "(?x) a b", "[.*]", r"x\\.*", r"\x{61}b", r"\\x", "a|b|c|d|e|f|g|h|i|j|k|l|m", "[a-zA-Z]1", "(a|b)(c|d)",
    "ab?c", "no$", "[^a-y ]", "(?i:Ab)c", "(?-i)ab", "yes|(?i)NO", r"\(a\)", "a\\|b", "[a&&b]", "[&]x", "x(?!y)",
)


@pytest.mark.parametrize("words, widest", [(10, 64), (0, 0), (10_000, 10_000)])
def test_occurs_equals_the_matcher(spark, monkeypatch, words, widest):
    """Any valid pattern, whatever the limits of the rewriting."""
    import random

    from callweave.functions import patterns

    monkeypatch.setattr(patterns, "MOST_WORDS", words)
    monkeypatch.setattr(patterns, "WIDEST_RANGE", widest)
    patterns.one_scan.cache_clear()
    rng = random.Random(words)
    parts = ["ab", "cd", "a", "b", "x", "y", " ", "\n", "NO", "no", "yes", "Refund", ".", "\\", "，", "1", "wait", "(a)", "|", "&", "]"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(7))) for _ in range(150)]
    texts += ["Refund please", "NO way", "cdcd", "xcdcd", "c", "cx", "yes", "wait.", "a.b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    pairs = [OTHER[i : i + 2] for i in range(0, len(OTHER) - 1, 3)]
    checks = [(p,) for p in OTHER] + [tuple(p) for p in pairs]
    try:
        for start in range(0, len(checks), 30):
            some = checks[start : start + 30]
            rows = df.select(
                "text",
                *[
                    F.struct(
                        occurs(text, *ps).alias("got"),
                        reduce(or_, [text.rlike(p) for p in ps]).alias("want"),
                    ).alias(f"c{i}")
                    for i, ps in enumerate(some)
                ],
            ).collect()
            for row in rows:
                for i, ps in enumerate(some):
                    assert row[f"c{i}"].got == row[f"c{i}"].want, (ps, row.text)
    finally:
        patterns.one_scan.cache_clear()
