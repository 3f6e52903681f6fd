"""Rules of the sixteen event types. Patterns, cue words, stages and levels."""

from __future__ import annotations

from dataclasses import dataclass, field

POSITIVE = r"增长|增加|提升|上修|预增|扭亏|盈利|利好|受益|突破|中标|签订|签署|获批|取得|通过|回购|增持|投产|达产|涨价|获|收到|确认|增强|改善|扩大|放量|加速|创新高|上调|上涨|提高"
NEGATIVE = r"下降|减少|下滑|预亏|亏损|下修|终止|取消|减持|诉讼|处罚|失败|被否|驳回|暂缓|停止|清仓|卖出|计提|减值|风险|不确定"
TERMINAL = r"终止|中止|取消|撤回|停止|暂缓|失败|未通过|被否|驳回"
NOT_TERMINAL = r"(?:未|不|不会|难以)\s*$"
DECIDED = r"(?:决定|审议通过|同意|宣布|正式)\s*(?:终止|中止|取消|撤回|停止|暂缓|失败|未通过|被否|驳回)"
CLEARLY_TERMINAL = r"失败|未通过|被否|驳回"
ABOUT_EVENTS = r"重组|收购|并购|回购|增持|合同|订单|中标|审批|注册|批文|上市|发行|投产|量产|达产|产能|项目|方案|计划|交易|股权|资产|客户|供货|临床试验|受理|许可|投标|招标"
REVIEWED = r"审核|审议|股东会|董事会|重组|收购|验收|检查|批准|注册|许可|测试|试验"
TREATMENT = r"治疗|化疗|放疗|用药|临床"
PERIODIC = r"半年度报告|年度报告|季度报告"
HYPOTHETICAL = r"若|如|如果|可能|或将|预计|有权|可以|会|风险|导致|发生|无法|是否|如发生|拟|择机|适时|可由|可自|可决定|或|或者|致使|则"
CONFLICT = (
    r"未能[^。；;]{0,16}(?:签订|签署|中标|获批|取得|完成|实施|投产|量产|增持|回购)|(?:终止|取消)[^。；;]{0,16}(?:合同|订单|项目|审批|回购|增持|重组|收购)|"
    r"(?:申请|交易|方案)[^。；;]{0,16}(?:被否|驳回|未获通过)|不予(?:批准|通过|许可|注册)|不构成(?:正式合同|订单|重大资产重组)|无实质(?:进展|影响)"
)
UNCERTAIN = r"终止|取消|诉讼|仲裁|审批失败|被否|客户(?:存在|仍存)不确定性|历史执行率(?:很|较)低|仅为方案|市场传闻|传闻"
PARTIAL = (
    r"尚未生效|履行周期(?:较|过)长|含税|非经常性|出售资产|资产处置收益|扣非后净利润(?:下降|下滑)|仅为方案|是否.{0,8}(?:落地|兑现|执行)|能否商业化|能否量产|尚未上市销售|"
    r"尚需[^。；;]{0,16}(?:履行|审批|通过|生效|签署|实施|完成)"
)
BEAT, FIRST, PROGRESS = r"超预期|提前(?:完成|投产|达产|实现)|创新高|刷新纪录|历史最高|首次突破", r"首次|第一次|开创|填补空白|突破|重大进展|里程碑", r"进展|更新|补充|修订|公告|披露"
EXECUTED = (
    r"已(?:到账|实施|执行|完成|取得|获批|落地|回购|增持|投产|量产|过户)|正式(?:投产|量产)|(?:投产|量产)(?:完成|成功)|顺利(?:投产|量产)|建成(?:投产|达产)|已[^。；;]{0,12}?(?:投产|量产)|"
    r"收到[^。；;]{0,48}(?:批复|批文|注册证|许可证)|(?:取得|获得)[^。；;]{0,24}(?:许可证|注册证|批件)"
)
SIGNED = r"签订|签署|正式合同|董事会(?:决议|审议)?通过|股东大会通过|审议通过|已通过|审核通过|过会|证监会(?:同意|核准|注册)"
AWARDED, RUMOR = r"中标|获选|评标|中选", r"传闻|市场消息|据悉|知情人士|或(?:将|有|存在)"
AUXILIARY = r"法律意见书|核查意见|验资报告|专项报告|审计报告|独立财务顾问报告"
PREFERRED_SECTION = r"主要会计数据|主要财务数据|经营情况讨论与分析|管理层讨论与分析|董事会报告|经营情况|主要经营情况|报告期内经营"
OTHER_SECTION = r"财务报表附注|附注|风险提示|备查文件|释义|公司简介"
EARNINGS = r"净利润|归母|扣非|业绩|扭亏|预盈|预增"
FORMAL = ("cninfo", "sse", "irm")
_NUMBER = r"([+-]?\d[\d,]*\.?\d*)\s*(?:%|个百分点)"


@dataclass(frozen=True)
class Rule:
    """What makes a document report an event of one type, and how the event is weighed.

    pattern must hit title and body; a title with not_title, or a text with yields, is no such event. levels are tried
    in order where no ratio gives one; stages likewise before the common ladder. needs: all must hit, else the event is
    kept without a mechanism. positive turns a neutral direction, makes_positive any (unless unless hits), and
    makes_negative any unless keeps hits. extra adds counter-evidence of a kind.
    """

    name: str
    pattern: str
    mechanism: str
    not_title: str | None = None
    yields: str | None = None
    ratio: str | None = None
    ratio_needs_amount: bool = True
    buyback: bool = False
    levels: tuple[tuple[str, int], ...] = ()
    level: int = 1
    level_with_amount: int | None = None
    stages: tuple[tuple[str, str], ...] = ()
    needs: tuple[str, ...] = ()
    positive: str | None = None
    makes_positive: str | None = None
    unless: str | None = None
    makes_negative: str | None = None
    keeps: str | None = None
    extra: tuple[tuple[str, str], ...] = field(default=())
    framework_uncertain: bool = False
    only_positive: bool = False
    qualitative: bool = False


RULES = (
    Rule("earnings_upgrade", r"业绩预告|业绩快报|业绩上修|预计净利润|归母净利润|扣非净利润|归属于上市公司股东的净利润|归属于上市公司股东的扣除非经常性损益的净利润|半年度报告|年度报告|季度报告|净利润.{0,40}(?:同比增长|较上年同期|增长|增加|预增|上修)|扭亏为盈|预盈", "业绩增长或扭亏为盈改善盈利预期", not_title=r"问询函|延期|无法按期|终止|取消", ratio=r"(?:同比|较上年同期|同比增长|净利润增长)[^。；;]{0,20}?" + _NUMBER, ratio_needs_amount=False, levels=((r"扭亏为盈|预盈|同比(?:增长|预增)", 2),)),
    Rule("major_contract", r"重大合同|签订(?:了)?合同|签署(?:了)?合同|中标|订单|供货合同|销售合同|合同金额|项目合同|协议金额", "新增合同或订单预计增厚未来营业收入", yields=r"进入.{0,12}(?:供应链|供应体系)|客户突破|合格供应商|批量供货", ratio=r"占[^。；;]{0,12}(?:营业)?收入[^。；;]{0,20}?" + _NUMBER, levels=((r"战略合作|大型|巨额|大额", 2),)),
    # the bare word before the bar needs no number behind it, so the ratio is then unknown
    Rule("price_increase", r"涨价|提价|上调(?:了)?(?:产品)?价格|价格上调|出厂价(?:上涨|上调)|产品价格(?:上涨|上调|提高)", "产品价格上涨直接提升单位盈利能力", ratio=r"涨幅|上调(?:幅度)?[^。；;]{0,10}?" + _NUMBER, ratio_needs_amount=False),
    Rule("approval", r"获批|批准|注册证|批件|上市许可|药品注册|临床试验(?:批件|批准)|通过(?:了)?.{0,12}(?:认证|审批|审核|备案)|(?:取得|获得)(?:了)?.{0,12}(?:证书|批文|许可|许可证)", "获批/认证为相关产品打开准入或商业化空间", not_title=r"专利|商标|软件著作权|知识产权|作品登记", levels=((r"量产|商业化|上市销售", 2),), stages=((r"获批|取得.{0,8}(?:批文|证书|注册证)", "executed"),)),
    Rule("buyback_or_increase", r"回购|增持|股份回购|股东增持|增持计划|回购方案|回购股份", "回购或增持改善资本结构与股东回报预期", not_title=r"(?:限制性股票|股权激励)[^。；;]{0,20}回购注销|回购注销[^。；;]{0,20}(?:限制性股票|股权激励)|行权价格|回购价格|调整[^。；;]{0,12}?价格", ratio=r"占(?:总股本|公司总股本)[^。；;]{0,12}?" + _NUMBER, buyback=True, framework_uncertain=True),
    Rule("mna", r"并购(?!买)|重组|收购|重大资产重组|重大资产购买|发行[^。；;]{0,24}?购买[^。；;]{0,20}?(?:资产|股权)|吸收合并|控制权变更|股权收购|资产注入|借壳", "并购重组可能增强资产或业务协同", not_title=r"子公司之间.{0,12}吸收合并|全资子公司.{0,20}(?:吸收合并|内部重组)|(?:吸收合并|内部重组).{0,20}全资子公司|问询函|延期|无法按期|回复(?:公告)?", levels=((r"重组|控制权变更|借壳|整体上市|资产注入", 4), (r"收购|并购|购买[^。；;]{0,20}?(?:股权|资产)", 3)), level=2, positive=r"收购|购买|注入|增持|优质资产|协同|增强盈利能力", makes_negative=r"出售|剥离|置出|转让|减持", keeps=r"收购|购买|注入|增持", qualitative=True),
    Rule("capacity_launch", r"投产|达产|量产|新增产能|产能释放|试生产|首条产线|产线(?:建成|投产)", "新增产能释放打开收入增长空间", levels=((r"新增产能|扩产|产能(?:翻|提升|释放)", 2),)),
    Rule("direct_policy_benefit", r"政策(?:利好|受益|支持|补贴)|国补|以旧换新|政府采购|专项债|税收优惠|退税|补贴政策|消费补贴", "政策直接覆盖公司业务，可能带来需求或成本改善", levels=((r"直接受益|利好|明确|落地|实施", 2),), only_positive=True),
    Rule("customer_breakthrough", r"进入(?:了)?.{0,12}(?:供应链|供应体系|客户名单|供应商)|获得(?:了)?.{0,12}客户|通过(?:了)?.{0,12}客户认证|客户突破|大客户|合格供应商|定点", "重要客户突破打开新增收入来源", levels=((r"量产|供货|订单|批量", 2),)),
    Rule("subsidy_or_compensation", r"政府补助|补贴|补偿|赔偿|获赔|补助(?:资金|款项)?|拆迁补偿", "补贴或赔偿直接增厚当期利润", yields=r"不存在[^。；;]{0,32}?(?:补偿|补贴|资助)|(?:不提供|未提供|未向|不得)[^。；;]{0,12}?(?:补偿|补贴|资助)", ratio=r"占[^。；;]{0,15}(?:净利润|利润总额|归母净利润)[^。；;]{0,12}?" + _NUMBER, extra=((r"上一年度已(?:确认|计入)|此前已(?:披露|预告|公告)|已计提|已实施完毕", "partial"),)),
    Rule("shareholder_return", r"现金分红|特别分红|分红方案|派息|分配预案|权益分派|利润分配预案|分红实施|分红派发|已回购股份(?:注销|并注销)|注销(?:所回购|已回购|回购)股份", "现金分红或回购注销提升股东现金回报", not_title=r"送股|转增|送转", ratio=r"占[^。；;]{0,12}(?:净利润|归母净利润|公司总市值|总股本)[^。；;]{0,20}?" + _NUMBER, levels=((r"特别分红|高比例|大额", 1),), level=0, stages=((r"实施|已实施|实施完毕|已完成|已注销", "executed"), (r"预案|方案|通过|拟", "signed"))),
    Rule("rd_milestone", r"临床(?:试验)?[^。；;]{0,24}(?:达到|达成|满足|实现)[^。；;]{0,24}(?:主要(?:临床)?终点|临床终点)|达到[^。；;]{0,12}(?:主要临床终点|临床终点)|未达(?:到)?[^。；;]{0,12}(?:主要(?:临床)?终点|临床终点)|注册申请(?:获|已)?受理|上市申请受理|关键技术(?:验证|突破)|(?:完成|通过)[^。；;]{0,12}(?:技术验证|临床前研究|临床(?:试验)?研究)|达到[^。；;]{0,16}主要终点", "关键研发里程碑推进产品商业化进程", not_title=r"获批|批准|注册证|批件|上市许可", levels=((r"突破|首个|首次|关键", 2),), stages=((r"受理", "framework"), (r"", "awarded")), positive=r"(?<!未)(?<!不)(?:达到|达成|满足|实现|完成|通过|受理)"),
    Rule("risk_resolution", r"撤销[^。；;]{0,10}(?:风险警示|退市风险警示)|(?:风险警示|退市风险警示)[^。；;]{0,20}(?:撤销|解除)|摘帽|(?:诉讼|仲裁|债务|担保|冻结|查封|监管)[^。；;]{0,16}(?:解除|撤销|终结|结案|和解|化解)", "重大风险事项正式解除，消除不确定性", level_with_amount=2, stages=((r"解除|撤销|终结|结案|和解|化解|摘帽", "executed"),), makes_positive=r"解除|撤销|终结|结案|和解|化解|摘帽", unless=r"被实施|新增|维持|继续"),
    Rule("equity_incentive", r"股权激励计划|限制性股票激励|限制性股票|股票期权激励|股权激励方案", "股权激励绑定核心团队利益，设量化考核目标", not_title=r"回购注销|注销", needs=(r"激励对象|激励人数|覆盖|人员", r"授予(?:数量|规模|股份|股票|限制性股票)|万股|万股数", r"考核(?:指标|目标)|业绩考核|营业收入.{0,12}考核|净利润.{0,12}考核"), levels=((r"授予(?:数量|规模)[^。；;]{0,12}?[\d,]+\.?\d*\s*万股|占(?:总股本|公司总股本)[^。；;]{0,12}?[+-]?\d[\d,]*\.?\d*\s*%", 2),), stages=((r"", "framework"),), makes_positive=r"", framework_uncertain=True),
    Rule("financing_completion", r"(?:非公开发行|定向发行|向特定对象发行)[^。；;]{0,20}(?:完成|募集资金到位|已到账)|可转换公司债券[^。；;]{0,20}(?:完成发行|上市)|发行完成|募集资金(?:到位|已到账)|配股[^。；;]{0,10}完成|(?:发行境外上市股份|境外发行上市|发行H股)[^。；;]{0,24}(?:备案|备案通知书)|(?:完成|成功)[^。；;]{0,16}?(?:发行|交割)|(?:发行|交割)[^。；;]{0,8}?完成", "融资完成并投向量化产能/项目，支撑公司级正向机制", not_title=r"预案|申请|获批|问询|回复", needs=(r"募集资金[^。；;]{0,30}?用于[^。；;]{0,24}(?:项目|产能|建设|研发|投入)[^。；;]{0,30}?[\d,]+\.?\d*\s*亿元|(?s:(?=.*(?:(?:已完成|完成|成功)[^。；;]{0,20}?(?:发行|交割|到账)|(?:交割|到账)[^。；;]{0,10}?完成)).*募集资金(?:总额)?(?:为)?[^。；;]{0,16}?[\d,]+\.?\d*\s*亿元)",), stages=((r"到位|完成", "executed"), (r"", "framework")), positive=r"发行完成|募集资金(?:到位|已到账)|已完成|成功发行|完成[^。；;]{0,12}?交割|交割[^。；;]{0,8}?完成", extra=((r"稀释|摊薄即期回报|发行费用", "partial"),)),
    Rule("asset_disposal", r"(?:出售|转让|处置)[^。；;]{0,12}(?:资产|股权|房产|土地|子公司)|重大资产出售|交割|成交", "资产处置回收现金或确认收益（一次性属性已标记）", needs=(r"已完成|已签署|交割|过户|成交", r"现金|回收|回款|投资收益|影响利润|利润(?:增加|提升)|增值"), level_with_amount=2, stages=((r"", "executed"),), extra=((r"一次性|非经常性", "partial"),)),
)
