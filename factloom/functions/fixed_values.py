"""Word lists, units, factors and thresholds the results depend on.

Everything here is small. The field vocabulary itself (fields, aliases, entity
names) is data, not code: it is passed in as a ``Vocabulary``.
"""

# Header names that mark the entity column of a table.
ENTITY_HEADERS = (
    "城市", "城市名称", "城市名", "地区", "区域", "省份", "名称", "项目", "实体",
    "公司", "国家", "国家/地区", "country", "country/region", "region",
    "province/state", "站点", "监测点位",
)

# Header names that mark a date column.
DATE_HEADERS = ("日期", "date", "时间", "监测时间", "日期时间", "datetime")

# Row-number headers that are read as dates only on request.
ROW_NUMBER_HEADERS = ("序号", "编号")

# Total / average pseudo-entities.
AGGREGATE_NAMES = (
    "全国", "合计", "总计", "平均", "全省", "全市", "总体", "全区", "均值",
    "中位数", "最大值", "最小值",
)

# Words that say nothing about a template's topic.
GENERIC_TOKENS = (
    "template", "doc", "docx", "xlsx", "sheet", "table", "report", "form",
    "output", "upload", "模板", "表格", "填表", "回填", "汇总", "统计", "结果",
    "数据", "文档",
)

# Words ignored when a template name is matched to file names.
FILENAME_STOP_WORDS = ("模板", "数据", "表", "汇总", "报告", "信息", "文件", "sheet", "table")

# Units read in table cells, and in running text.
CELL_UNITS = ("万亿元", "亿元", "万元", "元", "万人", "人", "%")
PROSE_UNITS = ("万亿元", "亿元", "万元", "元", "万人", "人", "万", "%")

# Unit families.
MONEY_UNITS = ("亿元", "万元", "元", "万亿元")
POPULATION_UNITS = ("万人", "人", "万")

# Conversions (field, from, to, multiply by, divide by).
UNIT_FACTORS = (
    ("GDP总量", "万亿元", "亿元", 10000.0, 1.0),
    ("GDP总量", "万元", "亿元", 1.0, 10000.0),
    ("GDP总量", "元", "亿元", 1.0, 100000000.0),
    ("一般公共预算收入", "万亿元", "亿元", 10000.0, 1.0),
    ("一般公共预算收入", "万元", "亿元", 1.0, 10000.0),
    ("一般公共预算收入", "元", "亿元", 1.0, 100000000.0),
    ("常住人口", "人", "万人", 1.0, 10000.0),
    ("常住人口", "万", "万人", 1.0, 1.0),
    ("人均GDP", "万元", "元", 10000.0, 1.0),
    ("人均GDP", "亿元", "元", 100000000.0, 1.0),
    ("合同金额", "万元", "元", 10000.0, 1.0),
    ("合同金额", "亿元", "元", 100000000.0, 1.0),
)

# Magnitude of a unit for number lookup by keyword.
UNIT_MAGNITUDE = {
    "": 1.0, "元": 1.0, "个": 1.0, "人": 1.0, "万": 1e4, "万元": 1e4,
    "万人": 1e4, "万份": 1e4, "亿": 1e8, "亿元": 1e8, "亿人": 1e8, "千": 1e3,
    "百": 1e2,
}

# Fields holding a party name, and the field holding a signing date.
PARTY_FIELDS = ("甲方", "乙方")
SIGNING_DATE_FIELD = "签订日期"

# Column-name hints of an entity column, and words that end an entity name.
ENTITY_COLUMN_HINTS = (
    "城市", "国家", "省", "地区", "名称", "实体",
    "city", "country", "province", "region", "name", "entity",
)
ENTITY_BREAKS = (
    "以", "紧随", "凭借", "凭", "借", "作为", "是为", "占据", "稳步", "在转型", "在此",
    "依靠", "依托", "成为", "表现", "当之无愧", "作为当", "紧追",
)

# Column-name hints of a date column.
DATE_COLUMN_HINTS = ("日期", "date", "时间", "time")

# Column-name hints that choose the aggregate of a rollup.
MEAN_HINTS = ("人均", "增长率", "比率", "同比", "环比")
MEAN_HINTS_LOWER = ("per capita", "rate", "%")
MEAN_SUFFIX = "率"
FIRST_HINTS = ("大洲", "洲", "国家代码", "continent", "时区")

# Candidates, in order, when the entity or time column is guessed.
ENTITY_COLUMN_GUESSES = (
    "城市", "city", "国家/地区", "country/region", "地区", "区域", "实体", "国家",
)
TIME_COLUMN_GUESSES = ("监测时间", "时间", "日期", "date", "创建时间")

# Marks of an instruction text.
INSTRUCTION_MARKERS = ("提示词", "prompt", "根据以下要求", "请根据", "输出要求", "填报说明")

# Fields whose values may be negative.
SIGNED_FIELDS = ("增长率", "增速")

# Labels before an entity list, before single entities, before a time.
LIST_LABELS = ("城市", "地区", "区域", "省份", "实体", "包含", "包括", "选取", "筛选", "只.*?")
SINGLE_LABELS = ("城市", "地区", "区域", "省份")
TIME_LABELS = ("监测时间", "时间", "日期", "采样时间", "检测时间")

# Administrative suffixes dropped from entity names.
ENTITY_SUFFIXES = ("市", "省")
TRAILING_SUFFIX_CHARS = "市县区省"
CITY_SUFFIX = "市"
