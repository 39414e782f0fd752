"""Rule tables and word lists.

Every operator takes its rules as a parameter; the tables here are the defaults. Patterns are Java regular expressions.
"""

from __future__ import annotations

from gleaner.functions.text import EDGE_AFTER, EDGE_BEFORE

# --------------------------------------------------------------------------------------------------------------------
# FIXED VALUES. Word lists, patterns, thresholds and labels below must be exactly these for right results.
# --------------------------------------------------------------------------------------------------------------------

# Corpus
DEFAULT_DOCUMENT_NAME = "未命名资料"
DEFAULT_DOCUMENT_TYPE = "knowledge"
NON_KNOWLEDGE_TYPES = ("skill", "converter-skill")
SNAPSHOT_VERSION = 1
FILE_SUFFIX = r"(?i)\.(md|markdown|go)\z"
CHUNK_CHARS = 1600
SENTENCE_DELIMITERS = "。！？；!?;"

# Sectioning
ARCHIVE_OFF = r"当前飞书版本"
ARCHIVE_ON = r"(?:完整原文资料|完整面试问题原文说明|历史飞书版本)"
PROVENANCE_LINE = r"^>[ \t]*(?:资料归类|来源|文档\s*token|当前飞书修订|当前原文字符数|同步说明|同步方式)[：:]"
FENCED_QUESTION = (
    r"(?iu)(?:[？?]\z|^(?:你|您|我们|项目|RAG|Agent|Prompt|Skill|Workflow|MCP).{0,24}"
    r"(?:怎么|如何|什么|为什么|多少|哪些|是否|有没有|架构|指标|职责))"
)

# Markup
BREAK_TAG = r"(?i)<br\s*/?>"
IMAGE_TAG = r"(?i)<img[^>]*>"
DIAGRAM_NODE_PATTERN = r'([A-Za-z][\w-]*)\s*\["?([^\]\n]+)"?\]'
DIAGRAM_EDGE_PATTERN = r"([A-Za-z][\w-]*)\s*[-=.]+>\s*([A-Za-z][\w-]*)"
IMAGE_PLACEHOLDER = "[图示：原图信息请参考飞书原文]"
EMPTY_RECORD_LINE = "- 说明：原表格此行没有可读取文字。"
RECORD_LINE = r"^-\s*记录\s*\d+：(.+)\z"
RECORD_FIELD_SEPARATOR, RECORD_LABEL_SEPARATOR, RECORD_DEFAULT_LABEL = "；", "：", "说明"
DIAGRAM_HEADER, DIAGRAM_NODE, DIAGRAM_EDGE, DIAGRAM_ARROW = "图示文字说明：", "- 节点：", "- 链路：", " → "
BOARD_REFERENCE = "> 图示：飞书画板（原文资源标识：`$1`）。图中可读取链路请以相邻标题和正文为准。"

# Annotation
PROFILE_LABEL = r"(?:自我介绍|个人经历|职业经历|我的情况|个人故事线|讲人设)"
PROFILE_OPENING = r"(?:个人故事线\s*)?(?:自我介绍)?\s*(?:您好[，,]?(?:我叫|我是)|我有\s*\d+\s*年.{0,12}经验)"
GENERIC_SOURCE = r"(?:面试口述|复盘原文|通用面试问题|通用资料|术语表|回答规则|Skill)"
GENERIC_PROJECT = r"(?:^(?:项目背景|项目概览|项目介绍|业务背景|方案设计|技术方案|技术架构|核心能力|复盘|附录)|通用|能力|方法论|面试)"
PROJECT_WORD = r"(?:项目|平台|系统|产品|业务)"
SOURCE_PREFIX = r"^(?:面试知识库|知识库|资料库)[-_—\s]*"
ROLE_RULES = (
    ("project-background", r"(?:项目背景|业务背景|为什么做|立项背景|用户痛点)"),
    ("project-solution", r"(?iu)(?:技术架构|技术方案|技术选型|RAG|Agent|Workflow|检索|召回)"),
    ("project-metric", r"(?:指标|结果|效果|提升|转化率|准确率|口径)"),
    ("project-retrospective", r"(?iu)(?:复盘|挑战|困难|难点|Bad\s?Case)"),
)
GENERAL_SCOPE_PROJECT = r"^(?:通用|AI 产品通用能力|产品方法论|技术专题)"
ALIAS_RULES = (
    (r"(?:自我介绍|个人经历|职业经历)", ("自我介绍", "介绍一下你自己", "说说你的情况", "介绍你的经历")),
    (
        rf"(?iu){EDGE_BEFORE}RAG{EDGE_AFTER}",
        ("RAG 是什么", "RAG 怎么做", "RAG 方案怎么设计", "检索增强生成怎么做"),
    ),
    (
        rf"(?iu)(?:{EDGE_BEFORE}Agent{EDGE_AFTER}|智能体)",
        ("Agent 怎么设计", "智能体怎么做", "Agent 架构是什么"),
    ),
    (r"(?:指标|得分|评分|口径|权重|计算)", ("指标怎么算", "评分规则怎么制定", "指标口径是什么")),
    (r"(?:挑战|难点|困难|问题)", ("项目挑战是什么", "遇到什么困难", "怎么解决难点")),
    (r"(?:项目介绍|项目概览|项目背景|项目定位)", ("介绍一下项目", "项目是做什么的", "项目背景是什么")),
)
ANSWER_MARKER = r"(?:^|\n)\s*(?:\*\*)?(?:回答方式|回答)\s*[：:](?:\*\*)?\s*"

# Glossary
GLOSSARY_ALIAS_LINE = r"(?iu)^\s*(?:[-*]\s*)?(?:别名|关键词|aliases?)\s*[:：]\s*(.+)\z"
CODE_ASR = r"(?:扣得|扣德|代码|code|c\s*o\s*d\s*e|coder)"
CONTEXT_RULES = (
    # (pattern, replacement, required context, vetoing context), applied in this order
    (r"最优(?=\s*(?:这个|该)?\s*(?:项目|平台|品牌增长))", "GEO", None, None),
    (
        r"(?iu)(?:deep\s*fake|deepfake)\s*(?:(?:有了解(?:吗)?|了解(?:吗)?|吗)\s*)?seek\s*(?:honey(?:s)?|harness)",
        "DeepSeek Harness",
        None,
        None,
    ),
    (r"(?iu)(?:d?eep)\s*seek\s*honey(?:s)?", "DeepSeek Harness", None, None),
    (rf"(?iu)(?:Claude\s*{CODE_ASR}|克劳德\s*{CODE_ASR})", "Claude Code", None, None),
    (
        r"(?iu)(?:OpenAI\s*)?(?:Codex\s*CLI|code\s*x|c\s*o\s*d\s*e\s*x|kodeks|可戴克斯|扣得\s*X)",
        "Codex",
        None,
        None,
    ),
    (
        r"(?iu)(?<![a-z0-9])scale(?![a-z0-9])",
        "Skill",
        r"(?iu)(?:^|\s)scale\s*(?:是(?:什么(?:意思)?|干什么|做什么)|什么意思|怎么(?:做|写|设计|用)"
        r"|和\s*(?:Agent|Workflow|Tool|RAG|智能体|工作流|工具).*(?:区别|不同|怎么选)|的(?:定义|作用|能力|好处))"
        r"(?:[？?。！!\s]*\z|\s)",
        r"(?iu)Scale\s*AI|规模化|扩大(?:到|至)?|扩展(?:到|至)?|用户|流量|并发|成本|算力|参数量|scaling\s*law",
    ),
    (
        r"(?iu)(?<![a-z0-9])lope(?![a-z0-9])",
        "Loop",
        r"(?:什么是|是什么|什么意思|怎么理解|定义|含义)",
        rf"(?iu)(?:{EDGE_BEFORE}MoE{EDGE_AFTER}|模型|推理|并行|专家|架构|算法|overhead)",
    ),
    (
        r"(?iu)(?<![a-z0-9])p\s*m\s*2(?:\.\s*5|5|五)(?![a-z0-9])",
        "BM25",
        None,
        r"(?iu)(?:空气|污染|雾霾|天气|颗粒物|AQI|口罩|环保|呼吸|浓度|指数|超标|今天\s*PM|PM\s*.*很高)",
    ),
)

# Query features
TECHNICAL_TERM = r"[a-z][a-z0-9_-]{1,}"
TITLE_TERM = r"[a-z][a-z0-9_-]{1,}|[\p{IsHan}]{2,}"
STOP_TOKENS = (
    "你", "我", "他", "她", "的", "是", "了", "在", "有", "过", "吗", "呢", "啊", "这", "那", "个",
    "一下", "什么", "如何", "怎么", "介绍", "是否", "能够", "可以",
)
SYNONYMS = ((rf"(?iu){EDGE_BEFORE}rubrics?{EDGE_AFTER}", "评分规则"),)
GENERIC_QUERY = (
    r"^(区别是什么|有什么区别|差别是什么|是什么|怎么做|如何做|为什么|然后呢|可以吗|有没有)\z"
)
TITLE_STOP_TERMS = ("什么", "怎么", "如何", "这个", "项目", "你们")
INTENT_RULES = (
    ("profile", r"(自我介绍|说说你的情况|介绍你的情况|介绍你的经历|个人情况|个人背景|职业经历)"),
    ("metric", r"(指标|得分|评分|怎么算|如何计算|计算方式|计算口径|权重)"),
    ("count", r"(几个|多少个|数量|几名|几类|几个有)"),
    ("fit", r"(适合|匹配|胜任|优势|为什么是你|为什么录用)"),
    ("definition", r"(什么是|是什么|区别|定义|怎么理解)"),
    ("agent", r"(?iu)(?:Agent|智能体|多智能体)"),
    ("knowledge", r"(知识库|检索).{0,10}(设计|构建|搭建|方案)|(?:设计|构建|搭建).{0,10}(知识库|检索)"),
    ("handoff", r"(转人工|人工接管|人工兜底|什么时候人工)"),
    ("architecture", r"(架构|怎么设计|如何设计|怎么搭)"),
    ("challenge", r"(挑战|困难|难点|问题|怎么解决|如何处理)"),
    ("result", r"(结果|成果|指标|提升了多少|效果)"),
)
DEFAULT_INTENT = "general"
# (intent, field, pattern, points): the first matching row of an intent decides
INTENT_BONUS = (
    ("profile", "role", r"^profile\z", 24),
    ("fit", "role", r"^profile\z", 42),
    ("metric", "title", r"(评分|指标|得分|计算|权重|口径)", 60),
    ("metric", "text", r"(评分|指标|得分|计算|权重|口径)", 10),
    ("count", "text", r"(\d+\s*个|[一二三四五六七八九十]+个|几个|多个|数量)", 18),
    ("definition", "title", r"(什么是|是什么|区别|定义)", 12),
    ("agent", "title", r"什么是\s*Agent|Agent（什么时候", 90),
    ("agent", "title", r"(?iu)(?:Agent|智能体)", 58),
    ("architecture", "text", r"(架构|设计|方案)", 9),
    ("knowledge", "title", r"RAG|知识库|检索", 56),
    ("handoff", "title", r"高风险场景|人工接管|转人工", 72),
    ("challenge", "text", r"(挑战|困难|难点|问题)", 9),
    ("result", "text", r"(结果|成果|指标|提升|效果)", 9),
)
CONCEPTS = (
    ("自我介绍", ("自我介绍", "说说你的情况", "介绍你的情况", "简单介绍你的经历", "个人情况", "个人背景", "职业经历")),
    ("指标", ("指标", "得分", "评分", "计算", "口径", "权重", "可见度")),
    ("挑战", ("挑战", "困难", "问题", "挫折", "难点", "阻碍")),
    ("解决", ("解决", "处理", "应对", "克服", "推进", "怎么做", "如何做")),
    ("项目", ("项目", "经历", "案例", "工作", "事情")),
    ("适合", ("适合", "匹配", "胜任", "优势", "为什么是你", "为什么录用")),
    ("离职", ("离职", "离开", "换工作", "跳槽", "为什么不留在")),
    ("架构", ("架构", "技术方案", "系统设计", "怎么搭", "整体方案")),
    ("效果", ("效果", "结果", "成果", "指标", "提升", "收益")),
    ("原因", ("原因", "为什么", "动机", "背景")),
    ("团队", ("团队", "协作", "合作", "同事", "跨部门")),
)
ANCHOR_RULES = (
    (
        r"(?:自我介绍|给我介绍|介绍一下(?:你|自己)?|讲讲(?:你|自己|背景)|个人背景|职业经历|为什么适合)",
        "自我介绍 个人经历 职业背景 核心优势 项目经历 为什么适合岗位",
    ),
    (r"(?:困难|难点|挑战|阻碍|卡点)", "项目难点 挑战 问题 如何解决"),
    (r"(?iu)(?:CEO|高层|老板|商业价值|ROI)", "CEO 高层视角 商业价值 ROI 战略 决策"),
    (
        r"(?:知识库|检索).{0,10}(?:怎么|如何|设计|搭建|构建)|(?:怎么|如何|设计|搭建|构建).{0,10}(?:知识库|检索)",
        "RAG 知识库 切片 Metadata 混合召回 Rerank 引用 评测",
    ),
    (
        r"(?:用了?(?:什么|哪些)技术|技术栈|技术架构|底层技术|技术方案)",
        "Agent RAG Workflow 模型调用 规则引擎 混合召回 向量检索 评测 人工审核",
    ),
    (r"(?:转人工|人工接管|人工兜底|低置信度|高风险|护栏)", "高风险场景 置信度 拒答 人工接管 审计 Workflow"),
    (
        r"(?iu)(?:评测|评估|Bad\s?Case|准确率|召回率|重排|效果)",
        "AI 产品评测 数据集 Rubric Bad Case Trace 回归集 离线评测 线上指标",
    ),
    (
        r"(?:项目).{0,12}(?:介绍|讲讲|说说|怎么做|是什么)|(?:介绍|讲讲|说说).{0,12}(?:项目)",
        "项目背景 业务问题 用户痛点 产品方案 技术架构 个人职责 指标结果 复盘",
    ),
)

# Scoring
GLOSSARY_SOURCE = r"AI产品经理术语表"
TITLE_WEIGHT, ALIAS_WEIGHT, PROJECT_WEIGHT, BODY_WEIGHT, TOKEN_CAP = 3, 2, 2, 1, 4
TITLE_PHRASE_POINTS, TITLE_COVERAGE_POINTS, TITLE_COVERAGE_MIN = 10, 24, 2
TERM_TITLE_POINTS, TERM_PROJECT_POINTS, TERM_BODY_POINTS = 16, 12, 6
CONCEPT_TITLE_POINTS, CONCEPT_BODY_POINTS = 4, 2

# Vectors and fusion
VECTOR_VERSION = 3
EMBEDDING_CHARS = 4_000
EMBEDDING_BATCH = 12
SIMILARITY_THRESHOLD = 0.7
RANK_CONSTANT = 60
SUBJECT_BOOST = 0.26
SUBJECT_PHRASE = r"[a-z][a-z0-9_-]*(?:\s+[a-z][a-z0-9_-]*)+"
FUSED_RESULTS, SEMANTIC_RESULTS, ROUTED_RESULTS = 12, 20, 4

# Turns and project context
INCOMPLETE_ENDINGS = ("然后", "比如", "因为", "我想问一下", "就是说", "怎么", "如何", "是否")
QUESTION_WORDS = (
    r"(吗|呢|么|多少|几个|哪些|什么|为什么|怎么|如何|能否|是否|介绍|负责|结果|挑战|实现|设计|区别|优势|缺点)"
)
FOLLOW_UPS = (
    r"^(?:为什么|然后呢|结果呢|展开讲讲|详细讲一下|具体怎么做|这个怎么做|这个详细讲一下)[？?。！!]?\z",
    r"^(?:哎[，,、\s]*)?(?:你)?(?:刚刚|刚才|前面|之前)(?:说|提到).+",
    r"^(?:(?:他|她|它)?这个|(?:他|她|它)?那个|该|这|那)项目",
)
COMPLETE_DELAY_MS, INCOMPLETE_DELAY_MS, FORCED_COMMIT_MS, MIN_COMMIT_CHARS = 1200, 2200, 3500, 4
STOCK_FOLLOW_UPS = r"^(为什么|然后呢|结果呢|展开讲讲|详细讲一下|具体怎么做|这个怎么做)\z"
UNKNOWN_PROJECT_BARRIER = (
    rf"(?iu){EDGE_BEFORE}C\.?E\.?O\.?{EDGE_AFTER}\s*(?:项目|平台|系统|的(?:问题|内容|挑战|方案|架构))"
)
CONTEXTUAL_SCOPE = (
    r"(?:(?:你们).*(?:指标|得分|评分|计算|口径|权重|架构|RAG|Agent|挑战|结果|优势|能力|功能|模型|工具|流程)"
    r"|(?:(?:你们|(?:他|她|它)?这个|(?:他|她|它)?那个|该|这|那)项目).*"
    r"(?:指标|得分|评分|计算|口径|权重|架构|RAG|Agent|挑战|结果|优势|能力|功能|模型|工具|流程)"
    r"|^(?:指标|得分|评分|计算口径|权重).*(?:怎么|如何|是什么|多少|有))"
)

# Question scope (tested on the text without blanks unless noted)
_TELL = r"^(?:请|麻烦)?(?:讲一下|讲讲|说说|介绍一下|介绍).{0,6}(?:你|您)"
_END = r"[。？?!！]*\z"
_CODING = r"(?:Coding|VibeCoding|编程|代码|Codex|ClaudeCode|Cursor|Qoder|Skill)"
OWN_PROJECT_OVERVIEW = (rf"{_TELL}(?:的)?项目{_END}", rf"{_TELL}(?:做过|负责|参与)(?:的)?项目{_END}")
BARE_INTRODUCTION = rf"^(?:请|麻烦)?(?:给我|给咱们|给大家)?介绍(?:一下)?{_END}"
EXPERIENCE_QUESTION = (
    r"(自我介绍|你的(项目|经历|背景|经验)|你(做过|负责|参与|当时|过去)|介绍(一下)?你(自己|的经历|做过)"
    r"|说说你(自己|的情况|做过))",
    r"(?iu)(?:我自己|我本人|我做过|我写过|我开发过|我搭过).{0,24}"
    r"(?:Coding|VibeCoding|编程|代码|Codex|ClaudeCode|Cursor|Qoder|Skill|项目)",
    r"(?iu)(?:Coding|VibeCoding|编程|代码|Codex|ClaudeCode|Cursor|Qoder).{0,24}"
    r"(?:我自己|我本人|我做过|我写过|我开发过|我搭过|我的项目)",
    *OWN_PROJECT_OVERVIEW,
    BARE_INTRODUCTION,
)
EXTERNAL_PRODUCT = (
    r"(?iu)(?:微信|朋友圈|抖音|小红书|淘宝|支付宝|美团|滴滴|微博|B站|知乎|Notion|Figma|iPhone|安卓|网页|App|界面"
    r"|按钮|点赞|评论|转发|入口|交互)",
    r"(?:你|您)(?:有没有|是否|用过|体验过|了解(?:过)?).{1,48}(?:产品|功能|服务|软件|工具)"
    r"|(?:这个|该|它的?).{0,8}(?:产品|功能|服务|软件|工具).{0,18}"
    r"(?:好处|优点|优势|价值|体验|好用|不好用|区别|取舍|问题)",
)
AI_DOMAIN = (
    r"(?iu)(?:AI|人工智能|大模型|模型|RAG|Agent|智能体|Prompt|检索|知识库|LLM|多模态|AIGC|生成式|机器学习)"
)
NAMED_AI_PRODUCT = (
    r"(?iu)(?:Kimi(?:\s*K\s*3)?|DeepSeek(?:\s*[VR]\s*\d+)?|Qwen(?:\s*[\w.-]+)?|豆包|Doubao|Gemini(?:\s*[\w.-]+)?"
    r"|Grok(?:\s*\d+)?|Claude(?:\s*[\w.-]+)?|ChatGPT|GPT(?:[-\s]*\d+(?:\.\d+)?)?|Llama(?:\s*[\w.-]+)?"
    r"|Hailuo(?:\s*\d+(?:\.\d+)?)?|Sora(?:\s*\d+)?)(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
NAMED_PRODUCT_QUESTION = r"(?:了解|介绍|用过|体验|好处|优点|优势|特点|能力|适合|区别|怎么选|评价|看法)"

# Material eligibility
PERSONAL_PRACTICE_FIRST_PERSON = r"(?:我自己|我本人|我做过|我写过|我开发过|我搭过|我的(?:Coding|编程|代码|项目))"
PERSONAL_PRACTICE_SUBJECT = rf"(?iu){_CODING}"
PERSONAL_PRACTICE_EVIDENCE = (
    r"(?iu)(?:我|我的|自己).{0,40}(?:Vibe\s*Coding|Coding|编程|代码|Codex|Claude\s*Code|Cursor|Qoder)"
)
PERSONAL_PRACTICE_MATERIAL = r"(?iu)(?:Vibe\s*Coding|Coding|编程|代码|Codex|Claude\s*Code|Cursor|Qoder)"
METHODOLOGY_SOURCE = r"面试知识库-通用面试问题"
TREND_QUESTION = (
    r"(?iu)(?:最近|近来|平时).{0,12}(?:关注|了解).{0,18}(?:AI|人工智能|大模型|模型|趋势)"
    r"|(?:AI|人工智能|大模型|模型).{0,12}(?:趋势|新发布|最近发布|新模型)"
)
TREND_EVIDENCE = (
    r"(?iu)(?:最近|近来).{0,12}(?:关注|了解).{0,18}(?:AI|人工智能|大模型|模型|趋势)"
    r"|(?:AI|人工智能|大模型|模型).{0,12}(?:趋势|新发布|最近发布|新模型)"
)
DIRECT_ANSWER_QUESTION = (
    r"(?iu)(?:RAG|Agent|Skill|Workflow|Prompt|检索|召回|重排|知识链路|技术栈|技术架构|用了什么.{0,10}技术)"
)
TECHNOLOGY_TITLE = (
    r"(?iu)(?:RAG|Agent|Skill|Workflow|Prompt|检索|召回|重排|知识链路|技术选型|技术架构|模型|工具边界)"
)
QUESTION_TITLE = r"(?:什么|怎么|如何|设计|架构|流程|评测|规则|区别|？|\?)"
PHRASE_FILLERS = r"(?:你们|你|我|请问|请|这个|那个|一下|怎么|如何|制定|设计|是什么|什么是|为什么|的吗|吗|呢|的|是)"
TITLE_FILLERS = r"(?:问题|回答|请问|请|你们|你的|你|我|怎么|如何|是什么|什么是|吗|呢|的|是)"
PERSONAL_CONTEXT_SCOPES = ("experience", "project", "followup")

# Routing
COUNT_QUESTION = r"(几个|多少个|数量|几名|几类)"
COUNT_EVIDENCE = r"(\d+\s*个|[一二三四五六七八九十]+个|数量)"
PROFILE_QUESTION = (
    r"(自我介绍|说说你的情况|介绍你的情况|介绍你的经历|个人情况|个人背景|职业经历)",
    BARE_INTRODUCTION,
)
ZERO_TO_ONE_QUESTION = (
    r"(?:从零到一|0到1).{0,12}(?:做|开发|设计).{0,12}(?:项目|产品).{0,16}(?:怎么|如何|会)",
    r"(?:如果让你|假如让你).{0,12}(?:做|开发|设计).{0,12}(?:项目|产品).{0,16}(?:怎么|如何|会)",
)
SCENARIO_QUESTION = (
    r"(?:如果|假如|给定|给你).{0,24}(?:场景|业务|需求).{0,36}(?:从零到一|0到1|怎么做|如何做|怎么设计|如何设计)",
    r"(?:从零到一|0到1).{0,28}(?:怎么做|如何做|怎么设计|如何设计)",
)
TECHNICAL_TOPIC = r"(?iu)(?:RAG|Agent|Workflow|Skill|指标|评分|Prompt|评测|召回|转人工)"
OVERVIEW_QUESTION = (
    r"(?:你这个|这个|该|你们的?|我负责的?(?:其中一个)?|我来|我给您|(?:讲讲|说说|介绍).{0,8}).{0,14}项目.{0,16}"
    r"(?:怎么|如何|介绍|做|讲)?",
    r"项目.{0,16}(?:怎么做|如何做|是什么|介绍|讲讲|说说)",
)
OVERVIEW_ALWAYS = r"(?iu)(?:营销智能回答|营销智能问答|attrip|at\s*trip)"
TECHNOLOGY_QUESTION = (
    r"(?:项目|系统).{0,22}(?:用.{0,12}技术|技术栈|技术架构|技术方案)|(?:用了什么|使用什么).{0,18}技术"
)
METADATA_TITLE = r"(?:当前飞书版本|历史飞书版本|完整原文资料|完整面试问题原文说明)"
METADATA_TEXT = (
    r"(?iu)(?:资料归类|来源[：:]\s*https?:\/\/|文档\s*token|当前飞书修订|同步说明|当前飞书全文将)"
)
OVERVIEW_PRIORITY = (
    (4, r"(?:项目简介|项目介绍|项目概览)"),
    (3, r"(?:项目定位|项目背景|业务背景)"),
    (2, r"(?:核心能力|整体解决思路|产品方案|项目方案|AI能力拆解)"),
    (1, r"(?:介绍|概览).{0,30}项目|项目.{0,30}(?:介绍|概览)"),
)
OVERVIEW_TAKE, OVERVIEW_FLOOR = 2, 20
TECHNOLOGY_PRIORITY = (
    (6, r"(?iu)(?:RAG|知识链路)"),
    (5, r"(?iu)(?:Agent|Skill|工具边界)"),
    (4, r"(?iu)(?:技术选型|技术架构|模型|Prompt)"),
    (2, r"(?iu)(?:编排|检索|召回|重排)"),
)
TECHNOLOGY_TAKE, TECHNOLOGY_FLOOR = 3, 18
DIFFERENCE_SUBJECT = r"^(.+?)(?:有什么|有何|是什么|什么是)?区别"
DIFFERENCE_SPLIT = r"(?:和|与|跟|及|、)"
DIFFERENCE_PREFIX = r"^(?:你们的|你们|这个|该)"
DIFFERENCE_GENERIC = r"^(?:模型|产品|项目|平台)\z"
REDO_QUESTION = r"(重新.{0,8}(做|设计).{0,8}项目|重新做一个项目)"
REDO_EVIDENCE = r"(重新.{0,20}(做|设计|项目)|复盘|重做|回顾)"
KEYWORD_FILLERS = r"你|我|他|她|这个|那个|项目|的|是|了|在|有|什么|怎么|如何|介绍|一下|请|问|吗|呢"
KEYWORD_TERMS = r"[a-z0-9]+|[\u4e00-\u9fff]{2,}"
DONE_QUESTION = r"(做过|负责过|参与过).{0,8}项目"
DONE_EVIDENCE = r"(做过|负责过|参与过).{0,20}(项目|平台|产品)"
IGNORED_CHARACTERS = "你我他她这那个的是了在有过吗呢啊什么怎如何介绍项目"
EVIDENCE_SIMILARITY, EVIDENCE_LIMIT, MATERIAL_LIMIT = 0.82, 3, 6
REASONS = {
    "overview_missing": "没有项目概览资料",
    "overview": "资料直接回答两个代表项目概览",
    "profile_missing": "没有个人经历资料",
    "direct": "资料直接回答核心问题",
    "zero_to_one": "通用从零到一方法论题，不引用无关项目资料",
    "scenario": "已锁定项目的场景方案题，使用项目背景和整体方案",
    "no_match": "资料未命中",
    "practice": "命中候选人的 Coding 实践资料，需要整合口述",
    "practice_missing": "没有候选人的 Coding 实践资料",
    "technology": "当前项目技术资料已命中",
    "explicit": "命中原文直接答案",
    "project": "已确认当前项目，整合项目资料回答",
    "generic": "只命中泛词，资料无法可靠回答",
    "compose": "需要整合多段资料",
    "supplement": "资料相关但未覆盖核心问题",
    "llm_only": "没有可直接支撑答案的本地资料，已使用 LLM 通用生成",
    "grounded": "已命中可直接支撑答案的本地资料",
}
# Context assembly: (items, characters per item)
CONTEXT_FULL, CONTEXT_FAST, CONTEXT_FOLLOW_UP = (4, 2200), (3, 1400), (3, 1100)
PROMPT_LIMITS = {"personal": 700, "previous": 2800, "template": 2200, "rules": 1800}
SCOPES = ("general", "experience", "project", "followup", "product")
SCOPE_LABELS = {
    "general": "通用方法论（禁止带入个人经历或特定项目）",
    "product": "外部产品分析（禁止带入候选人经历、项目资料或 AI 技术方案）",
}
REQUEST_TEMPERATURE, REQUEST_MAX_TOKENS = 0.2, 900

# Transcripts, signals, streams
COMPARISON_PUNCTUATION = r"[，,。.!！?？、:：;；'\"“”‘’()（）\-_]"
QUESTION_CUE = r"[?？]|什么|怎么|如何|为何|为什么|哪些|多少|几个|吗|呢"
REPEATED_PHRASES = (r"请?介绍", r"介绍一下", r"请问", r"你觉得")
QUESTION_STARTERS = ("如果", "你的", "你这个", "你们", "你做过", "介绍一下", "说说", "请问")
TURN_CUE = r"(吗|呢|么|多少|几个|哪些|什么|为什么|怎么|如何|优势|挑战|经历|项目|介绍|负责|结果)"
GENERIC_TAIL = r"^(?:区别是什么|有什么区别|怎么做|如何做|你会怎么做)\z"
CONDITION_SENTENCE = r"(?:如果|假如|假设|让你|从零到一|在.+情况下|给你)"
CONDITION_TAIL = r"^(?:那|你|会|该|然后|接下来).*(?:怎么|如何|为什么|是否|能否|可以)"
WHOLE_INTRODUCTION = r"^(?:(?:请|我说|你说|能否|可以)?你?)?自我介绍(?:一下)?\z"
VOICE_RMS = 0.012
SILENCE_MS, FINAL_WAIT_MS, FRAME_GAP_MS, RECOVERY_MS = 3_000, 2_500, 1_600, 3_000
TARGET_RATE, PCM_NEGATIVE, PCM_POSITIVE = 16_000, 0x8000, 0x7FFF
FOLLOW_UP_TURNS = 3

# --------------------------------------------------------------------------------------------------------------------
# Example dictionaries (ours): a few entries showing the shape; real deployments pass their own.
# --------------------------------------------------------------------------------------------------------------------
EXAMPLE_CORRECTIONS = (("RAG", ("R A G", "阿瑞吉")), ("DeepSeek", ("Deep Sleep",)))
EXAMPLE_GLOSSARY = (
    ("RAG", ("检索增强生成", "检索增强")),
    ("Agent", ("智能体",)),
    ("Workflow", ("工作流",)),
    ("GitHub Copilot", ("git hub copilot",)),
    ("GitHub", ("git hub",)),
)
