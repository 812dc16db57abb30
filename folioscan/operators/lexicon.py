"""Terms and advice of each domain, as tables that a caller can replace."""
from pyspark.sql import DataFrame, SparkSession

# The terms of each domain, in order.
TERMS = {
    "insurance": "保险责任 责任免除 等待期 免赔额 赔付比例 身故保险金 满期保险金 现金价值 账户价值 已交保险费 退保 养老年金 领取日",
    "regulatory": "第 条 款 项 应当 不得 可以 必须 无需 工作日 施行 备案 报告 股东会 特别决议 普通决议 三分之二 过半数",
    "financial_contracts": "发行人 发行主体 发行规模 募集资金 注册金额 债项评级 主体信用评级 受托管理人 主承销商 担保 增信 赎回 回售 违约 兑付",
    "financial_reports": "营业收入 归属于上市公司股东的净利润 净利润 经营活动产生的现金流量净额 研发投入 研发费用 占营业收入比例 现金分红 利润分配 同比 增长 下降 资产负债率",
    "research": "市场规模 预计 预测 同比 复合增速 CAGR 渗透率 保费 营收 竞争格局 行业趋势 风险提示 图表",
}
# What marks a kind of task, in order, and the flag of each answer format.
TASKS = (
    ("cross_document", "两份|多份|对比|比较|分别|均|都|第一份|第二份|连续两年|两年"),
    ("calculation", "计算|比例|金额|高于|低于|超过|不超过|占|增长|下降|复合增速|CAGR|排序"),
    ("clause_applicability", "应当|不得|可以|必须|无需|须经|条|款|项|施行|备案|报告|责任免除"),
    ("table_metric", "指标|年度|财务|现金流|营业收入|净利润|研发|分红|评级|发行规模"),
    ("true_false", "判断题|正确|错误"),
)
FORMATS = (("tf", "true_false"), ("multi", "multi_select"), ("mcq", "single_select"))
FIRST_DOC, SECOND_DOC = "第一份|首份|前一份|第一[个家]", "第二份|后一份|另一份|第二[个家]"


def default(spark: SparkSession) -> DataFrame:
    """domain, terms: a handful of rows."""
    return spark.createDataFrame([(d, t.split()) for d, t in TERMS.items()], "domain string, terms array<string>")
