"""The Mandarin rule set of collection calls, as data."""

from __future__ import annotations

from callweave.functions.columns import AGENT, USER
from callweave.functions.rules import Rule, RuleSet, Trigger

# ---------------------------------------------------------------------------
# Patterns, weights, thresholds and codes. Results depend on
# every character of them.
# ---------------------------------------------------------------------------

TIME_PHRASES = (
    "(?:今天|明天|后天)上午",
    "(?:今天|明天|后天)下午",
    "(?:今|明|后|几|这几|过几|等几|缓几|这两|一|二|三|四|五|六|七|八|九|十|十几)天",
    "(?:一|二|三|四|五|六|七|八|九|十|十一|十二|晚|晚一|一两|两三|三四|四五|五六|六七|七八|九十)点",
    "(?:一|二|三|四|五|六|七|八|九|十|十一|十二|一两|两三|三四|四五|五六|六七|七八|九十)点钟",
    "下午(?:一|二|三|四|五|六|七|八|九|十|十一|十二|晚|晚一|一两|两三|三四|四五|五六|六七|七八|九十)点",
    "下午(?:一|二|三|四|五|六|七|八|九|十|十一|十二|一两|两三|三四|四五|五六|六七|七八|九十)点钟",
    "上午(?:一|二|三|四|五|六|七|八|九|十|十一|十二|晚|晚一|一两|两三|三四|四五|五六|六七|七八|九十)点",
    "上午(?:一|二|三|四|五|六|七|八|九|十|十一|十二|一两|两三|三四|四五|五六|六七|七八|九十)点钟",
    "(?:一|二|两|三|四|五|六|七|八|九|十|十一|十二|十三|十四|十五|十六|十七|十八|十九|二十|二十一|二十二|二十三|二十四|二十五|二十六|二十七|二十八|二十九|三十|三十一)号",
    "(?:一|二|三|四|五|六|七|八|九|十)个小时还|(?:一|二|三|四|五|六|七|八|九|十)个半小时还|半小时还|半个小时",
    "周(?:一|二|三|四|五|六|末)",
    "(?:这|过几|一|二|三|四|五|六|七|八|九|十|几|下|下下)周",
    "这(?:一|二|三|四|五|六|七|八|九|十|几)周",
    "(?:这|过几|一|二|三|四|五|六|七|八|九|十)个月",
    "这(?:一|二|三|四|五|六|七|八|九|十|几|下|下下)个月",
    "星期(?:一|二|三|四|五|六|日)|下午|中午|晚上|上午|尽量|等一下|等下",
    "(?:下班|等下班|发工资)还",
)

DENIALS = (
    r"(，|。|！|？)?[^，。！？]*(跟|与|和|给)(，|。|！|？)?[^，。！？]*(无|没)[a-zA-Z0-9_\x{4e00}-\x{9fa5}]*(关系|关)[^，。！？]*(，|。|！|？)",
    "不认识",
    "打错了",
    "毫无关系",
)

TIME_ASKED = Trigger("time_asked", AGENT, TIME_PHRASES)
KNOWING_DENIED = Trigger("knowing_denied", USER, DENIALS)

AGENT_RULES = (
    Rule("mention_repayment_time", "A",
         any_of=("今天|明天|后天|早上|早晨|上午|中午|下午|晚上|今晚|点钟?之?前|小时|天之内|天内",)),
    Rule("mention_owing_amount", "A",
         any_of=("(拖|欠款|欠|逾期|借|贷款|待还|到期|还款|还)[^几]{1,10}(块|元|千|百)",)),
    Rule("mention_default_days", "A",
         any_of=("(拖|欠|逾期|借|贷款|到期)[^今明后]{0,5}(天|月)",)),
    Rule("persuasion_money_loss", "B",
         cues=(
             ("0.1", "^.*每.*"),
             ("0.1", "^.*拖.*"),
             ("0.1", "^.*六点七.*"),
             ("0.2", "^.*(增长|涨|越高).*"),
             ("0.2", "^.*产生.*"),
             ("0.2", "^.*承担.*"),
             ("0.2", "^.*不必要|额外.*"),
             ("0.3", "^.*(划不来|不划算).*"),
         ),
         gate="^.*(费用|罚息|罚金|利息|罚款|滞纳金|违约金|六点七).*",
         above="0.3", speaker=AGENT),
    Rule("persuasion_credit_loss", "B",
         cues=(
             ("0.3", "^.*(联|连)网.*"),
             ("0.3", "^.*记录.*"),
             ("0.2", "^.*上传.*"),
             ("0.2", "^.*互联网.*"),
             ("0.1", "^.*维护.*"),
             ("0.1", "^.*个人.*"),
             ("0.1", "^.*(累积|累计).*"),
             ("0.3", "^.*买(车|房).*"),
             ("0.3", "^.*上征信.*"),
             ("0.3", "^.*拉黑.*"),
             ("0.1", "^.*影响.*"),
             ("0.2", "^.*人民银行|央行|芝麻.*"),
             ("0.1", "^.*消除.*"),
             ("0.1", "^.*名誉.*"),
         ),
         gate="^.*(上?征信|信誉|上?黑名单|(信用[^社卡借贷])).*",
         above="0.4", speaker=AGENT),
    Rule("persuasion_contact", "B",
         cues=(
             ("0.3", "^.*笑话|嘲笑.*"),
             ("0.3", "^.*搞得.*"),
             ("0.1", "^.*影响.*"),
             ("0.1", "^.*联系.*"),
             ("0.2", "^.*名声|声誉.*"),
             ("0.3", "^.*眼光.*"),
             ("0.3", "^.*面子.*"),
         ),
         gate="^.*(家人朋友|亲友|亲戚朋友|亲朋好友|居委|村委|邻居|街坊).*",
         above="0.4", speaker=AGENT),
    Rule("persuasion_law", "B",
         cues=(
             ("0.3", "^.*调查.*"),
             ("0.3", "^.*户籍.*"),
             ("0.3", "^.*签收.*"),
             ("0.3", "^.*违约.*"),
             ("0.2", "^.*流程|移交.*"),
             ("0.3", "^.*核实.*"),
             ("0.3", "^.*走.*"),
             ("0.3", "^.*身份证.*"),
         ),
         gate="^.*(寄送?|派出所|备案|涉嫌|法律|案件|程序|信函).*",
         above="0", speaker=AGENT),
    Rule("persuasion_crime", "B",
         any_of=("^.*(诉讼|事务所|司法|刑法|诈骗|合同法|违法|犯罪|骗贷|公安局|报案|法院|传票|开庭|受审|辩护).*",)),
    Rule("check_last_phone", "C", speaker=AGENT,
         any_of=(
             "(，|。|！|？)?[^，。！？]*(上次|之前|上一次|以前|上一通|上通)(，|。|！|？)?[^，。！？]*电话[^，。！？]*(，|。|！|？)",
             "(，|。|！|？)?[^，。！？]*(上次|之前|上一次|以前|上一通|上通)(，|。|！|？)?[^，。！？]*(您|你)(，|。|！|？)?[^，。！？]*(说|答应|讲)[^，。！？]*(，|。|！|？)",
             "(?:给|和|跟)(?:你|您)(?:打过电话|来过电话)",
             "(，|。|！|？)?[^，。！？]*(上次|之前|上一次|以前|上一通|上通)(，|。|！|？)?[^，。！？]*(说|答应|讲)(，|。|！|？)?[^，。！？]*(我们|我)?[^，。！？]*(，|。|！|？)",
             "有没有(?:给|和|跟)(?:你|您)(?:打电话|打过电话|来过电话)",
             "(?:您|你)上次说",
             "(?:上次|之前|上一次|以前|有)问(?:您|你)的时候",
             "(?:您|你)跟我们工作人员",
             "(?:上次|之前|上一次|以前|有)(?:给|和|跟)(?:您|你)说",
         )),
    Rule("is_refusal_time_bargain", "D", any_of=("不", "否"), after=TIME_ASKED),
    Rule("is_argue", "F", speaker=AGENT,
         any_of=(
             "(，|。|！|？)?[^，。！？]*你[^，。！？]*(答应)[^，。！？]*(，|。|！|？)",
             "(，|。|！|？)?[^，。！？]*你[^，。！？]*(不守信用)[^，。！？]*(，|。|！|？)",
             "(，|。|！|？)?[^，。！？]*说好[^，。！？多吧呀吗呢(不好)]+(，|。|！|？)",
             "(，|。|！|？)?[^，。！？]*说好[^，。！？多吧呀吗呢(不好)]+(，|。|！|？)",
         )),
    Rule("is_debtor_nearby", "G", speaker=AGENT, null_for="self",
         any_of=(
             "(，|。|！|？)?[^，。！？]*在[^，。！？]*(旁边|身边|你这里)[^，。！？]*(，|。|！|？)",
             "(，|。|！|？)?[^，。！？]*在不在[^，。！？]*(，|。|！|？)",
         )),
    Rule("is_knowing", "H", null_for="self",
         any_of=("(，|。|！|？)?[^，。！？]*(认识|联系(到|上)|有联系|跟(您|你)联系)[^，。！？]*(，|。|！|？)",)),
    Rule("is_askrelation", "I", null_for="self",
         any_of=("(，|。|！|？)?[^，。！？]*你[^，。！？]*(朋友|亲戚|同事|学生|老师|爸|妈)[^，。！？]*(，|。|！|？)",)),
    Rule("reaction_notknowing_anfu", "J", speaker=AGENT, after=KNOWING_DENIED,
         any_of=("(，|。|！|？)?[^，。！？]*(别(担心|误会)|放心|只是|不是说)[^，。！？]*(，|。|！|？)",)),
    Rule("reaction_notknowing_fangqi", "M", speaker=AGENT, after=KNOWING_DENIED,
         any_of=("(，|。|！|？)?[^，。！？]*(再见)[^，。！？]*(，|。|！|？)",)),
    Rule("reaction_notknowing_zhiwen", "K", speaker=AGENT, after=KNOWING_DENIED,
         any_of=("(，|。|！|？)?[^，。！？]*(您不?是|号码|手机号|不要跟我说|怎么可能|确定|频繁)[^，。！？]*(，|。|！|？)",)),
    Rule("reaction_notknowing_qingqiu", "L", speaker=AGENT, after=KNOWING_DENIED,
         any_of=("(，|。|！|？)?[^，。！？]*(看一下|号码|紧急联系人|手机号|打个电话|如果能|转告)[^，。！？]*(，|。|！|？)",)),
    Rule("check_other_call",
         any_of=("(，|。|！|？)?[^，。！？]*我[^，。！？]*(打|联系|通话)[^，。！？]*(过|了)[^来]{0,}[^，。！？]*(，|。|！|？)",)),
    Rule("mention_address",
         any_of=("(，|。|！|？)?[^，。！？]*(市|省|自治区)[^，。！？]*(县|区|乡|湾|镇)[^，。！？]*(，|。|！|？)",)),
    Rule("mention_number",
         any_of=("(，|。|！|？)?[^，。！？]*号码[^，。！？]*(零|幺|二|四|五|六|七|八|九)[^，。！？]*(，|。|！|？)",)),
    Rule("is_provpmorigin",
         any_of=("^.*(他|她|本人)留(到|在|的|你|了|下).*",
                 "^.*((第三|投资)(人|方))留(到|在|的|你|了|下).*")),
    Rule("mention_photo",
         all_of=("照片", "(身份证|个人|背景|资料|你|他|借款|贷款|拍)")),
)

USER_RULES = (
    Rule("is_askingmethod", "2",
         any_of=("(，|。|！|？)?[^，。！？]*((不会|怎么样?)还|还不进去?)[^，。！？]*(，|。|！|？)",)),
    Rule("is_rejection", "7",
         any_of=("(，|。|！|？)?[^，。！？]*(不|为什么|怎么)(，|。|！|？)?[^，。！？]*转告[^，。！？]*(，|。|！|？)",
                 "就不还|就是不还|不想还钱|没钱还|确实还不了|还不了|就是故意不还|确定不还|没钱")),
    Rule("mention_nocall", "9",
         any_of=("(，|。|！|？)?[^，。！？]*(不要)(，|。|！|？)?[^，。！？]*(联系|电话)[^，。！？]*(，|。|！|？)",
                 "骚扰")),
    Rule("is_complaint", speaker=USER,
         any_of=("(，|。|！|？)?[^，。！？]*我[^，。！？]*投诉[^，。！？]*(，|。|！|？)",)),
    Rule("is_notknowing", "4", null_for="self",
         any_of=("(，|。|！|？)?[^，。！？]*(不认识|没联系)[^，。！？]*(，|。|！|？)",)),
    Rule("mention_noconnection", "6", null_for="self", any_of=DENIALS),
    Rule("is_askingreduction", "1", null_for="contact",
         any_of=("(，|。|！|？)?[^，。！？]*(减免|减少一?点)[^，。！？]*(，|。|！|？)",)),
    Rule("time_bargain", "3", speaker=USER, null_for="contact", any_of=TIME_PHRASES),
    Rule("is_helping",
         any_of=("(，|。|！|？)?[^，。！？]*(试|一定)[^，。！？]*(，|。|！|？)",)),
    Rule("is_investigation", null_for="self",
         all_of=("为什么", "(拖|处理|解决|钱)")),
    Rule("is_detail", null_for="self",
         any_of=("(，|。|！|？)?[^，。！？]*(借|欠|逾期|贷|拖|剩)(，|。|！|？)?[^，。！？]*(多少|多久)[^，。！？]*(，|。|！|？)",)),
)

#: Flags whose codes make up the sequence text of an agent turn.
AGENT_SEQUENCE = (
    "mention_repayment_time", "mention_owing_amount", "mention_default_days",
    "persuasion_money_loss", "persuasion_credit_loss", "persuasion_contact",
    "persuasion_law", "persuasion_crime", "check_last_phone",
    "is_refusal_time_bargain", "is_argue", "is_debtor_nearby", "is_knowing",
    "is_askrelation", "reaction_notknowing_anfu", "reaction_notknowing_fangqi",
    "reaction_notknowing_zhiwen", "reaction_notknowing_qingqiu",
)

#: Flags whose codes make up the sequence text of a customer turn.
USER_SEQUENCE = (
    "is_askingmethod", "is_rejection", "mention_nocall", "is_askingreduction",
    "time_bargain", "is_notknowing", "mention_noconnection", "is_complaint",
)

#: Flags reported only when the customer flag on the right is set in the call.
SHOWN_ONLY_WITH = {
    "is_refusal_time_bargain": "time_bargain",
    "reaction_notknowing_anfu": "is_notknowing",
    "reaction_notknowing_fangqi": "is_notknowing",
    "reaction_notknowing_zhiwen": "is_notknowing",
    "reaction_notknowing_qingqiu": "is_notknowing",
}

#: Forced words of the segmentation.
SPOKEN_WORDS = ("打个电话", "打电话")

MANDARIN = RuleSet(agent=AGENT_RULES, user=USER_RULES)
