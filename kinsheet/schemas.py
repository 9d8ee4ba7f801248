"""Column names and fixed values shared by every stage."""

from pyspark.sql import types as T

# --- fixed values: stored headers, texts and limits that outputs must carry verbatim ---
SHEET_HEADER = ("序号", "应用系统名称")
HEADER_SCAN_ROWS = 30
TOTAL_MARK = "合计"
CHINESE_NUMERALS = "零〇一二三四五六七八九十百千万两"
MODULE_SUFFIX = "模块"

RECORD_HEADERS = {
    "group_id": "组编号",
    "platform_id": "平台编号",
    "platform_name": "平台名称",
    "system_id": "系统编号",
    "system_name": "系统名称",
    "software_id": "软件编号",
    "software_name": "软件名称",
    "module_id": "模块编号",
    "module_name": "模块名称",
}
EXCLUDED_HEADERS = {
    "platform_id": "平台编号",
    "platform_name": "平台名称",
    "system_id": "系统编号",
    "system_name": "系统名称",
    "title": "被排除的分类标题",
    "source_row": "原始行号",
}
RESULT_HEADERS = ["序号", "比较层级", "相似度排名", "BGE-M3余弦相似度", "相似等级"]
CONFIG_HEADERS = {"key": "参数", "value": "值", "description": "说明"}

LABEL_EXACT = "名称完全相同"
LABEL_BANDS = [(0.90, "极高相似"), (0.85, "高相似"), (0.75, "中等相似")]
LABEL_LOW = "低相似"
LABEL_UNMATCHED = "无匹配"

ISSUE_NO_NAME = "序号 %s 对应的名称为空，已跳过"
ISSUE_NO_PLATFORM = "系统行缺少当前平台"
ISSUE_NO_PARENT = "软件行缺少当前平台或系统"
ISSUE_NO_SOFTWARE = "模块行缺少当前软件，已跳过"
ISSUE_UNKNOWN = "无法识别序号格式 %s，已跳过"
ISSUE_PREFIX = "第 %d 行：%s"

FLATTEN_CONFIG = [
    ("comparison_mode", "within", "默认在同一组内比较"),
    ("comparison_levels", "software,module", "仅执行软件同层、模块同层比较"),
    ("same_level_only", "true", "禁止软件与模块跨层比较"),
    ("similarity_threshold", "0.85", "初始工程阈值，正式使用前应人工校准"),
    ("top_k", "10", "每个对象最多保留的相似候选数量"),
    ("include_unmatched", "false", "是否输出无匹配对象"),
    ("remove_module_suffix", "false", "是否在计算时删除名称末尾的“模块”"),
]
RUN_CONFIG_NOTES = {
    "anchor_group": "定向跨组比较的基准组",
    "target_groups": "定向跨组比较的目标组",
    "similarity_threshold": "初始工程阈值，正式使用前应基于人工标注名称对校准",
    "similarity_metric": "L2 归一化稠密向量的余弦相似度，不是概率或重复率",
    "same_level_only": "固定为 true，软件与模块不得跨层比较",
}
RUN_CONFIG_DEFAULT_NOTE = "本次实际运行参数"
# --- end of fixed values ---

LEVELS = ("software", "module")
MODES = ("within", "cross", "all")

RECORD_COLUMNS = list(RECORD_HEADERS)
REQUIRED_COLUMNS = RECORD_COLUMNS[:7]
SOFTWARE_COLUMNS = RECORD_COLUMNS[:7]

SHEET_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("row_number", T.LongType(), False),
        T.StructField("serial", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)
RECORD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in RECORD_COLUMNS]
    + [T.StructField("input_seq", T.LongType(), False)]
)
VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("norm_name", T.StringType(), False),
        T.StructField("vec", T.ArrayType(T.FloatType(), False), False),
    ]
)
