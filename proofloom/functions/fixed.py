"""Fixed values.

Word lists, code tables, labels, patterns and thresholds that results depend
on. They are data, stated plainly and in natural order; nothing here is
computed.
"""

# --- codes -----------------------------------------------------------------
# Letter + up to three letters + one to three digits.
CODE_PATTERN = r"(?<![A-Z0-9])([AGEDS][A-Z]{0,3}\d{1,3})(?!\d)"
CODE_PREFIX = r"[AGEDS][A-Z]{0,3}"

# First letter of a code -> dimension folder and description.
DIMENSIONS = [
    ("A", "A-总体概况"),
    ("G", "G-公司治理"),
    ("E", "E-环境保护"),
    ("D", "D-产业价值"),
    ("S", "S-人权与社会"),
]

# Letters of a code -> topic folder.
TOPIC_FOLDERS = [
    ("GA", "GA-可持续发展治理"),
    ("GB", "GB-规范治理与党建"),
    ("GC", "GC-商业行为"),
    ("EA", "EA-应对气候变化"),
    ("EB", "EB-污染物管控"),
    ("EC", "EC-资源利用"),
    ("ED", "ED-生态多样性"),
    ("DA", "DA-科技创新"),
    ("DC", "DC-产品质量与客户"),
    ("DD", "DD-供应链管理"),
    ("DE", "DE-信息安全与数据"),
    ("SA", "SA-社会贡献与乡村振兴"),
    ("SB", "SB-社区关系"),
    ("SC", "SC-劳工权益"),
    ("SD", "SD-安全生产"),
]
OTHER_DIMENSION_SUFFIX = "-其他"
OTHER_TOPIC_SUFFIX = "-议题"
ROOT_FOLDER = "根目录文件"

# --- files -----------------------------------------------------------------
# File names that are never material.
SKIP_NAME = r"(?i)(^\.|^~|Thumbs\.db$|\.DS_Store$|\.db$)"
SKIP_CHECKLIST = r"(?i)(定性.*ESG.*资料清单|定量.*ESG.*资料清单)"
SKIP_README = "📋说明.txt"

# Extension -> reader.
READERS = [
    (".pdf", "pdf"),
    (".docx", "docx"),
    (".doc", "docx"),
    (".xlsx", "xlsx"),
    (".xls", "xlsx"),
    (".pptx", "pptx"),
    (".ppt", "pptx"),
    (".jpg", "image"),
    (".jpeg", "image"),
    (".png", "image"),
]

# --- spreadsheet headers -----------------------------------------------------
# Words that make a header row or name a column.
TOPIC_WORDS = ["议题"]
INDICATOR_WORDS = ["指标"]
KEY_WORDS = ["序号", "编号", "编码", "识别编码", "类别", "维度"]
SERIAL_WORDS = ["序号", "编号"]
SERIAL_WORD = "序号"
CATEGORY_WORDS = ["类别", "维度"]
CODE_WORDS = ["识别编码", "编码"]
MATERIAL_WORD = "资料"
REQUIREMENT_WORDS = ["资料列表", "资料"]
DEPARTMENT_WORDS = ["对接部门", "部门"]
REMARK_WORDS = ["备注"]
FRAMEWORK_GLOSS_WORDS = ["释义", "gloss"]
FRAMEWORK_CODE_WORDS = ["编码", "code"]
LEVEL1_WORDS = ["一级维度", "维度"]
LEVEL2_WORDS = ["二级议题", "议题"]
LEVEL3_WORDS = ["三级指标"]
LEVEL4_WORDS = ["四级指标"]
CHECKLIST_HEADER_ROWS = 200
FRAMEWORK_HEADER_ROWS = 50

# First levels of a report that are not chapters.
EXCLUDED_FIRST_LEVELS = [
    "封面", "目录", "关于本报告", "可持续发展亮点",
    "董事长致辞", "未来展望", "报告附录", "封底",
]

# --- headings ----------------------------------------------------------------
# Heading styles and numbering.
HEADING_STYLE = r"(?i)heading|标题|\bTitle\b"
DOTTED_NUMBER = r"^(\d+(?:\.\d+)*)[\.、\s]"
HAN_NUMBER = r"^(?:[一二三四五六七八九十]+[\.、\s]|第[一二三四五六七八九十百\d]+[章节条款])"
HEADING_MAX_CHARS = 30

# --- splitting ---------------------------------------------------------------
# Separators tried in this order, and size limits.
SEPARATORS = ["\n\n", "\n", "。", "，"]
CHUNK_MAX = 1200
CHUNK_MIN = 100
TABLE_ROWS = 30
TABLE_CONTEXT_CHARS = 300
PARENT_LIMIT = 2000
TITLE_PERCENTILE = 0.75
TITLE_MAX_CHARS = 200
TITLE_RATIO_MAX = 0.50
TITLE_MIN_COUNT = 2
SLIDE_PAGES = 5
SLIDE_ASPECT = 1.2
SLIDE_BLOCK_CHARS = 80
SLIDE_IMAGES = 1
PAGE_MIN_CHARS = 30

# --- images --------------------------------------------------------------------
# Image kinds, and the smallest image worth describing.
IMAGE_KINDS = ["文档扫描件", "表格截图", "照片", "流程图", "数据图表", "证书", "其他"]
IMAGE_KIND_DEFAULT = "其他"
OCR_KINDS = ["文档扫描件", "表格截图"]
PHOTO_MARK = "类型：照片"
IMAGE_MIN_BYTES = 5120
IMAGE_MIN_WIDTH = 100
IMAGE_MIN_HEIGHT = 100
OCR_MIN_CHARS = 10

# --- alignment -------------------------------------------------------------------
# Status mark, label, review order, stored status.
STATUSES = [
    ("✅", "一致", 3, "consistent"),
    ("➕", "一致且有额外关联", 2, "consistent"),
    ("⚠️", "疑似错位", 0, "misplaced"),
    ("🔍", "无路径标签但语义命中", 1, "no_folder"),
    ("➖", "低相关", 4, "low_relevance"),
    ("❓", "无命中", 5, "low_relevance"),
]
NO_CHECK = "有路径编码但无语义验证"
NO_EVIDENCE = "无任何证据"
RELEVANT = ["✅", "➕", "⚠️", "🔍"]
REVIEW = ["⚠️", "🔍", "➕"]
DEFAULT_STATUS = "low_relevance"
TOP_K = 5
TOP_N = 5
EXTRA_SCORE = 0.75
MIN_SCORE = 0.40
ALL_LOW = "所有chunk均低相关（top1 < %.2f）"
NO_CHUNKS = "提取失败或无有效内容"

# --- ranking -----------------------------------------------------------------------
# Fusion, BM25 and rerank parameters.
RRF_K = 60
FOLDER_BOOST = 0.5
BM25_TOP = 100
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
COARSE_TOP = 50
FINAL_TOP = 10
MISSING_RANK = 9999
SAME_SCORE = 0.02
SAME_RANK = 5
BRACKETS = [("≥ 0.60", 0.60), ("0.50-0.59", 0.50), ("0.40-0.49", 0.40), ("0.30-0.39", 0.30)]
BRACKET_REST = "< 0.30"

# --- drafts ---------------------------------------------------------------------------
# Markers, labels and limits of drafted text.
SOURCE_TAG = r"\[来源([\d,，、\s\-–]+)\]"
PENDING_TAG = r"\[待补充[：:]([^\]]+)\]"
EMPTY_SOURCE_TAG = "[来源]"
NO_CONTENT = "[NO_CONTENT]"
UNKNOWN_FILE = "未知文件"
UNKNOWN_PAGE = "?"
TEXT_MISSING = "[原文未找到]"
DRAFT_MIN_SCORE = 0.50
DRAFT_TEXT_LIMIT = 2000
WORDS_PER_CITATION = 200
BATCH_SIZE = 15
UPLOAD_LIMIT = 4000
REPORT_STATUSES = ["generated", "reviewed", "approved"]

# --- runs -----------------------------------------------------------------------------
# Fixed value: error of a run that ended without a word.
LOST_RUN = "Process exited unexpectedly"
