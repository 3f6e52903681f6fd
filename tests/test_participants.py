"""Lists of participants: broken, glued and joined names."""

import pytest

from tidemark.operators import participants as P

KNOWN = ["中金公司", "正心谷", "申万宏源", "淡马锡", "ubs", "gic", "morganstanley", "工银瑞信", "国联民生", "中信建投证券"]
CASES = {
    "wrapped": ("参与单位名称\n国寿安保基金、中信期货、淳厚基金、大\n湾区发展基金、阳光保险、IGWT\nInvestment、TX Capital、三井住友德思资管、高\n毅资产、合晟资产\n交流内容：略\n", ["国寿安保基金", "中信期货", "淳厚基金", "大湾区发展基金", "阳光保险", "IGWT Investment", "TX Capital", "三井住友德思资管", "高毅资产", "合晟资产"]),
    "tail": ("参与单位名称\n国信证券、汇添富基金、中信建投证\n券、盘京投资、平安资管、华泰资产及个\n人投资者等\n时间 2026 年 5 月 11 日\n", ["国信证券", "汇添富基金", "中信建投证券", "盘京投资", "平安资管", "华泰资产"]),
    "glued": ("参与单位名称\n浙商证券、正心谷中金公司、中欧基金、申万宏源、淡马锡\n时间 2026 年 8 月 2 日\n", ["浙商证券", "正心谷", "中金公司", "中欧基金", "申万宏源", "淡马锡"]),
    "and": ("参与单位：淡水泉投资和中欧基金、和风亚洲基金、和中金公司\n交流内容：略\n", ["淡水泉投资", "中欧基金", "和风亚洲基金", "中金公司"]),
    "persons": ("参与单位名称及人员姓名\n南方基金史博、应帅、邹寅隆、陈梓源、华泰证券王龙钰、国联民生周泰\n时间 2026 年 5 月 15 日\n", ["南方基金", "华泰证券", "国联民生"]),
    "colons": ("参与单位名称\n道仁资产：李晓光\n国新投资：孙语梁、王千、马浩翔\n上海瀛赐私募：陈翼\n1、开源证券：徐剑峰\n时间 2026 年 6 月 4 日\n", ["道仁资产", "国新投资", "上海瀛赐私募", "开源证券"]),
    "latin": ("参与单位：Morgan Stanley、Point72 Hong Kong、DM Capital Limited、UBS、GIC、中信证券\n交流内容：略\n", ["Morgan Stanley", "Point72 Hong Kong", "DM Capital Limited", "UBS", "GIC", "中信证券"]),
    "table": ("参会投资者清单\n投资者名单\n序号 公司\n1 工银瑞信\n2 泰康资产\n3 长江证券\n", ["工银瑞信", "泰康资产", "长江证券"]),
    "rows": ("时间：2026年8月5日\n参与单位：\n中信证券股份有限公司 张小明 研究员\n华泰证券 李大华 研究员\n", ["中信证券股份有限公司", "华泰证券"]),
    "remarks": ("参与单位名称\n敦美投资（参会者已签署承诺书）、天风证\n券股份有限公司（中小盘研究团队）\n地点：会议室\n", ["敦美投资", "天风证券股份有限公司"]),
    "prose": ("交流内容：\n公司结合小分子、多肽药物等新药研发技术平台优势，\n参与单位名称\n中信证券、中金公司\n时间 2026年7月9日\n", ["中信证券", "中金公司"]),
    "totals": ("参与单位：约30家机构\n", []),
    "none": ("没有名单", None),
    "null": (None, None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "record string, text string")
    known = spark.createDataFrame([(k,) for k in KNOWN], "alias string")
    return {r.record: r.names for r in P.listed_names(rows, "record", "text", known, "alias").collect()}


@pytest.mark.parametrize("case", CASES)
def test_names(found, case):
    assert found.get(case) == CASES[case][1]


def test_unknown_names_stay_whole(spark):
    rows = spark.createDataFrame([(1, "参与单位：正心谷中金公司、甲乙丙丁戊\n")], "record long, text string")
    none = spark.createDataFrame([], "alias string")
    assert [r.names for r in P.listed_names(rows, "record", "text", none, "alias").collect()] == [["正心谷中金公司"]]
