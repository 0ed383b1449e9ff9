"""Inputs of the operators, derived from the test tables.

The test tables hold conversations, events and order lines. Each function here
derives one input table of the library from them with built-in expressions; the
same derivations exist as SQL in ``workload.sqlparts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callweave.operators.calls import asof_allocation, enrich_calls, latest_per_call
from callweave.operators.reports import NUMERIC
from callweave.operators.turns import build_turns
from callweave.functions.rules_zh import MANDARIN
from callweave.sources.tables import read_table

#: Sentences added to the conversation lines, so that Mandarin rules have work.
PHRASES = (
    "今天下午之前要处理",
    "欠款三千五百元",
    "已经逾期十天了",
    "每天的罚息还在增长，这样拖下去划不来",
    "每天都有利息，不要拖",
    "每天利息由你承担",
    "记录会上传到征信，影响个人信用",
    "记录影响征信",
    "家人朋友会看笑话，面子上过不去",
    "案件移交流程已经走了",
    "法院会开庭发传票",
    "上次电话里你答应过今天还",
    "说好明天处理的",
    "他在你旁边吗",
    "你认识他吗，能联系到他吗",
    "你是他的朋友还是同事",
    "别误会，我只是核对一下",
    "好的，再见",
    "这个号码您是机主吗，确定吗",
    "麻烦转告他，打个电话给我",
    "我之前打过电话给您了",
    "地址是四川省成都市武侯区吗",
    "号码是幺三八九零",
    "您是他留的紧急联系人",
    "请拍一下身份证照片",
    "不行，不可以再拖",
    "怎么还，还不进去",
    "我没钱还",
    "为什么要我转告",
    "不要再打电话骚扰我",
    "我要投诉你们",
    "我不认识他",
    "我跟他没有任何关系",
    "能不能减免一点",
    "我过几天发工资还",
    "我试试看，一定转告",
    "为什么拖到现在才处理钱的事",
    "我欠了多少，逾期多久",
    "打错了",
    "喂，你好",
    "嗯，好的",
)

MONTH = "2024-01"
SINCE, BEFORE = "2024-01-01", "2024-02-01"
CUTOFF = "2024-01-15"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the spoken turns: ``conv_id, turn, channel, seg_no, line, rt_text``."""
    spoken = read_table(spark, sf, "conversations").filter(
        F.col("role").isin("user", "assistant")
    )
    agent = (F.col("role") == "assistant") | ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    split = spoken.select(
        "conv_id",
        "turn",
        F.when(agent, "AGENT").otherwise("USER").alias("channel"),
        F.posexplode(F.split("text", "\n")).alias("seg_no", "line"),
    )
    pick = (
        F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("seg_no") * 5 + F.length("line")
    ) % len(PHRASES)
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (pick + 1).cast("int"))
    return split.withColumn(
        "rt_text", F.concat("line", F.lit("，"), phrase, F.lit("。"), _exchange())
    )


#: What customer and agent say in some conversations, so that the rules that look at the
#: turn before have work: a denial, and a farewell or a reassurance.
DENIAL, FAREWELL, REASSURANCE, REDUCTION = "我不认识他。", "好的，再见。", "别误会，我只是核对一下。", "能不能减免一点。"


def _exchange() -> Column:
    user = F.col("channel") == "USER"
    return F.coalesce(
        F.when(
            (F.col("seg_no") == 0) & (F.col("conv_id") % 3 == 0),
            F.when(user, DENIAL).when(F.col("conv_id") % 2 == 0, FAREWELL).otherwise(REASSURANCE),
        ),
        F.when((F.col("seg_no") == 0) & (F.col("conv_id") % 3 == 1) & user, REDUCTION),
        F.lit(""),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised segments."""
    return lines(spark, sf).select(
        F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("new_name"),
        F.col("conv_id").cast("string").alias("file_name"),
        F.col("channel").alias("rt_role"),
        "seg_no",
        "rt_text",
    )


def raw_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Raw segments with speed; some calls run over two dates."""
    late = ((F.col("conv_id") % 23 == 5) & (F.col("seg_no") % 2 == 1)).cast("int")
    day = (F.col("conv_id") + late) % 28 + 1
    return lines(spark, sf).select(
        F.col("conv_id").cast("string").alias("file_name"),
        F.col("channel").alias("rt_role"),
        F.concat(F.lit("2024-01-"), F.lpad(day.cast("string"), 2, "0")).alias("file_date"),
        "rt_text",
        (100 + F.length("line") % 50).cast("double").alias("rt_speed"),
    )


def turns(spark: SparkSession, sf: str, target: str | None = None) -> DataFrame:
    return build_turns(segments(spark, sf), raw_segments(spark, sf), target=target)


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").filter(F.col("event_type") != "signup")


def _record_columns() -> list[Column]:
    owner = F.col("event_id") % 10
    return [
        (F.col("event_id") % 7).cast("string").alias("dnis"),
        F.col("ts").alias("ringtime"),
        F.floor("value").cast("int").alias("t_durtion"),
        "user_id",
        owner.alias("owner_id"),
        F.concat(F.lit("agent_"), owner.cast("string")).alias("owner_name"),
        F.concat(F.lit("group_"), (owner % 3).cast("string")).alias("group_name"),
    ]


def call_records(spark: SparkSession, sf: str) -> DataFrame:
    """Call records of the transcribed calls; some calls have two users.

    Late events become the low call numbers, so that earlier allocations exist.
    """
    events = read_table(spark, sf, "events")
    last = events.select(F.max("event_id")).scalar()
    calls = _calls(spark, sf).withColumn("calluuid", (last - F.col("event_id")).cast("string"))
    second = calls.filter(F.col("event_id") % 17 == 3).withColumn(
        "user_id", F.col("user_id") + 1
    )
    return calls.unionByName(second).select("calluuid", *_record_columns())


def sip_records(spark: SparkSession, sf: str) -> DataFrame:
    """Telephone-system records: user and case as text, some cases unreadable."""
    events = read_table(spark, sf, "events")
    last = events.select(F.max("event_id")).scalar()
    return _calls(spark, sf).select(
        (last - F.col("event_id")).cast("string").alias("calluuid"),
        F.col("ts").alias("createtime"),
        F.col("ts").alias("ringtime"),
        F.col("user_id").cast("string").alias("ud_1"),
        F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("x"), "event_id"))
        .otherwise(F.col("event_id").cast("string"))
        .alias("ud_2"),
        (F.col("event_id") % 10).cast("string").alias("dn"),
        (F.col("event_id") % 7).cast("string").alias("dnis"),
        F.floor("value").cast("int").alias("t_durtion"),
    )


def extensions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("extensionnumber"),
        F.col("s_suppkey").alias("user_id"),
    )


def roster(spark: SparkSession, sf: str) -> DataFrame:
    """Agents by day: those with an event that day."""
    days = (
        read_table(spark, sf, "events")
        .select((F.col("event_id") % 10).alias("owner_id"), F.to_date("ts").alias("dt"))
        .distinct()
    )
    names = read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("owner_id"),
        F.col("s_name").alias("owner_name"),
        F.concat(F.lit("group_"), (F.col("s_suppkey") % 3).cast("string")).alias("group_name"),
    )
    return days.join(names, "owner_id")


def allocations(spark: SparkSession, sf: str) -> DataFrame:
    return (
        read_table(spark, sf, "events")
        .filter(F.col("event_type") == "signup")
        .select(
            F.col("user_id").alias("borrow_user_id"),
            F.col("ts").alias("time_mark"),
            F.col("event_id").alias("dun_case_id"),
            (20 + F.col("event_id") % 60).alias("overdue_max_days"),
        )
    )


def directory(spark: SparkSession, sf: str) -> DataFrame:
    return (
        read_table(spark, sf, "events")
        .filter(F.col("event_type") == "click")
        .select(
            "user_id",
            (F.col("event_id") % 7).cast("string").alias("phone"),
            F.to_date("ts").alias("dt"),
            (1 + F.col("event_id") % 9).cast("int").alias("order_id"),
        )
    )


def performance(spark: SparkSession, sf: str) -> DataFrame:
    sold = read_table(spark, sf, "lineitem").join(
        read_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return sold.select(
        F.col("l_suppkey").alias("owner_id"),
        F.col("l_orderkey").alias("dun_case_id"),
        (F.col("l_extendedprice") * F.col("l_discount") * 10).alias("dun_repay_amount"),
        F.col("l_extendedprice").alias("start_owing_amount"),
        F.col("p_type").alias("model"),
    )


def event_calls(spark: SparkSession, sf: str) -> DataFrame:
    """All non-signup events as calls, without allocation."""
    return _calls(spark, sf).select(
        F.col("event_id").cast("string").alias("callid"),
        F.date_format("ts", "yyyy-MM-dd").alias("file_date"),
        *_record_columns(),
    ).withColumnsRenamed({"dnis": "phone", "t_durtion": "duration"})


def event_calls_allocated(spark: SparkSession, sf: str) -> DataFrame:
    """Event calls with their latest allocation."""
    matched = asof_allocation(
        event_calls(spark, sf), allocations(spark, sf), SINCE, BEFORE
    ).withColumnRenamed("allocated_case", "dun_case_id")
    return latest_per_call(matched).withColumn("time_mark", F.to_date("time_mark"))


def event_calls_plus(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_calls(event_calls_allocated(spark, sf), directory(spark, sf))


def event_features(spark: SparkSession, sf: str) -> DataFrame:
    """A feature table over the event calls; figures and flags from the call number."""
    number = F.col("callid").cast("long")
    flag = lambda j: (
        F.when(F.floor(number / (j + 2)) % 4 == 0, "true")
        .when(F.floor(number / (j + 2)) % 4 != 1, "false")
    )
    return event_calls_plus(spark, sf).select(
        F.col("file_date").alias("dt"), "owner_id", "user_id", "dun_case_id", "callid",
        F.col("phone_type").alias("contact_type"), "ringtime", "duration",
        (number % 30 + 1).alias("t_interaction"),
        (100 + number % 41 / 4).alias("collector_speed"),
        F.when(number % 9 != 0, 90 + number % 37 / 8).alias("receiver_speed"),
        (number % 16 / 16).alias("ratio_collector_char"),
        (number % 64 / 4).alias("jingban_mean_sentence_num"),
        (number % 64).alias("jingban_max_sentence_num"),
        (number % 48 / 4).alias("yonghu_mean_sentence_num"),
        (number % 48).alias("yonghu_max_sentence_num"),
        "time_mark", "is_first_yes_call", "yes_call_num", "day_num",
        *[flag(j).alias(n) for j, n in enumerate(MANDARIN.names)],
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents; as calls of an agent where the source serves as owner."""
    return read_table(spark, sf, "documents")
