"""Word lists, look-up tables, patterns and constants.

Everything in this module is data that must have exactly these values for
results to be right.  Order matters wherever a list is scanned for the first
match.
"""

# --- line cleaning ---------------------------------------------------------
PAGE_LINE_PATTERNS = [
    r"^第\s*\d+\s*页\s*(共\s*\d+\s*页)?$",
    r"^页码[:：]?\s*\d+$",
    r"^Page\s*\d+(\s*/\s*\d+)?$",
]
HEADER_LINE_PATTERNS = [
    r"^中华人民共和国.+$",
    r"^最高人民法院.+$",
    r"^中国裁判文书网.+$",
    r"^（?以下称.+）?$",
]
#: First characters of all lines that the patterns above match.
NOISE_LINE_STARTS = ["第", "页", "P", "p", "中", "最", "（", "以"]
TEMPLATE_LINES = ["本页无正文", "以下无正文", "特此公告", "以上事实，有证据在卷佐证。"]
ASCII_PUNCTUATION = ",;:?!()"
FULLWIDTH_PUNCTUATION = "，；：？！（）"
COLLAPSIBLE_FULLWIDTH = "，。；：！？"
COLLAPSIBLE_MIXED = "，。；：！？,.!?;:"
KEY_PUNCTUATION = "，。；：！？,.!?、（）()-"

# --- numerals and article references ----------------------------------------
NUMERAL_CLASS = "[一二三四五六七八九十百千万零两〇0-9]"
ARTICLE_PATTERN = f"第{NUMERAL_CLASS}+条"
CHAPTER_PATTERN = f"第{NUMERAL_CLASS}+[章节编]"
ZH_DIGITS = "零一二三四五六七八九"
ZH_UNITS = ["", "十", "百", "千"]
COUNTRY = "中华人民共和国"
ARTICLE_LAWS = ["刑法", "民法典", "公司法", "劳动合同法", "劳动争议调解仲裁法"]
LAW_NAME_CANDIDATES = [
    "中华人民共和国刑法",
    "中华人民共和国民法典",
    "中华人民共和国公司法",
    "中华人民共和国劳动合同法",
    "最高人民法院关于审理买卖合同纠纷案件适用法律问题的解释",
    "最高人民法院关于审理民间借贷案件适用法律若干问题的规定",
]
# Articles whose law is known without any context.
ARTICLE_HOME = {"二百六十四": "刑法", "五百七十七": "民法典"}

# --- structuring ------------------------------------------------------------
CASE_TYPE_WORDS = ["盗窃", "诈骗", "违约", "租赁", "侵权", "公司", "劳动"]
CASE_TYPE_SUFFIX = "纠纷"
COURT_PATTERN = "([\\x{4e00}-\\x{9fff}]{2,}(?:人民法院|法院))"
DISPUTE_PATTERN = "争议焦点[：:](.+)"
JUDGMENT_PATTERN = "(?:裁判结果|判决如下)[：:](.+)"
FAQ_TOPIC_WORDS = ["盗窃罪", "诈骗罪", "合同违约", "租赁纠纷", "侵权责任", "公司纠纷", "劳动争议"]
FAQ_DEFAULT_TOPIC = "一般法律咨询"
ENTITY_ALIASES = {
    "房东": "出租人",
    "房主": "出租人",
    "租客": "承租人",
    "租户": "承租人",
    "盗窃行为": "盗窃罪",
    "诈骗行为": "诈骗罪",
}

# --- chunking ----------------------------------------------------------------
CHUNK_SIZE = 400
CHUNK_OVERLAP = 80
CASE_HEADERS = ["案情", "争议焦点", "法院认为", "本院认为", "裁判理由", "裁判结果", "裁判要旨", "判决结果", "审理查明"]
PREFIX_SECTION = "案情"
WINDOW_SECTION = "sliding_window"
LAW_SOURCE_TYPES = ["law", "laws", "statute"]
CASE_SOURCE_TYPES = ["case", "cases", "judgment"]
FAQ_SOURCE_TYPES = ["faq", "qa"]
CASE_CONTENT_WORDS = ["案情", "法院认为", "本院认为", "裁判结果", "争议焦点"]
CHUNK_LAW_WORDS = {
    "刑法": "中华人民共和国刑法",
    "民法典": "中华人民共和国民法典",
    "公司法": "中华人民共和国公司法",
    "劳动合同法": "中华人民共和国劳动合同法",
    "劳动争议调解仲裁法": "中华人民共和国劳动争议调解仲裁法",
}

# --- entity extraction -------------------------------------------------------
CASE_NAME_PATTERN = r"\b([A-Z][a-zA-Z]+ v\. [A-Z][a-zA-Z ]+)\b"
SECTION_PATTERN = r"\b(Section\s+\d+)\b"
DATE_PATTERN = r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+\d{4})\b"
CAPITALISED_PATTERN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
ENGLISH_CONCEPTS = [
    "breach of contract",
    "causation",
    "damages",
    "duty of care",
    "foreseeability",
    "injunctive relief",
    "negligence",
    "wrongful eviction",
]
ZH_ARTICLE_REFERENCE = (
    f"((?:《?中华人民共和国(?:刑法|民法典)》?|刑法|民法典)?第{NUMERAL_CLASS}+条)"
)
ZH_STATUTE_NAME = (
    "(中华人民共和国刑法|中华人民共和国民法典|中华人民共和国公司法|中华人民共和国劳动合同法"
    "|中华人民共和国劳动法|中华人民共和国民事诉讼法|刑法|民法典|公司法|劳动合同法|劳动法"
    "|民事诉讼法|消费者权益保护法|电子商务法|保险法|个人信息保护法)"
)
ZH_PARTY = (
    "(张某|李某|王某|赵某|钱某|孙某|周某|吴某|郑某|刘某|陈某|甲公司|乙公司|丙公司|某公司"
    "|法院|原告|被告)"
)
ZH_CONCEPTS = {
    "盗窃罪": "盗窃罪",
    "盗窃行为": "盗窃罪",
    "抢劫罪": "抢劫罪",
    "抢劫行为": "抢劫罪",
    "抢劫": "抢劫罪",
    "诈骗罪": "诈骗罪",
    "诈骗行为": "诈骗罪",
    "诈骗": "诈骗罪",
    "侵权责任": "侵权责任",
    "共同侵权": "共同侵权",
    "违约责任": "违约责任",
    "预期违约": "预期违约",
    "损失赔偿": "损失赔偿",
    "违约金": "违约金",
    "租赁合同": "租赁合同",
    "买卖合同": "买卖合同",
    "职务侵占": "职务侵占",
    "职务侵占罪": "职务侵占",
    "不动产登记": "不动产登记",
    "物权变动": "物权变动",
    "举证责任": "举证责任",
    "出资义务": "股东出资义务",
    "勤勉义务": "董事勤勉义务",
    "暴力方式夺取财物": "抢劫罪",
    "持械抢夺财物": "抢劫罪",
    "虚构投资项目骗取钱款": "诈骗罪",
    "骗取钱款": "诈骗罪",
    "利用职务便利侵占单位财物": "职务侵占",
    "未按期缴纳出资": "股东出资义务",
    "迟延履行": "违约责任",
    "明确表示不履行主要债务": "预期违约",
    "违约损失赔偿范围": "损失赔偿",
    "违约金明显过高": "违约金",
    "催告后承租人仍不付租金": "租赁合同",
    "连续三个月不付租金": "租赁合同",
    "董事违反勤勉义务": "董事勤勉义务",
    "股东未按期缴纳出资": "股东出资义务",
}

# --- graph --------------------------------------------------------------------
APPLIES_CONCEPTS = [
    "盗窃罪",
    "违约责任",
    "诈骗罪",
    "侵权责任",
    "抢劫罪",
    "职务侵占",
    "股东出资义务",
    "董事勤勉义务",
    "租赁合同",
    "不动产登记",
    "预期违约",
    "损失赔偿",
]
CONSTITUTES = "构成"
COMPANY_STOPWORDS = ["the", "inc", "corp", "corporation", "llc"]
NODE_ALIASES = {
    "盗窃行为": "盗窃罪",
    "盗窃": "盗窃罪",
    "抢劫": "抢劫罪",
    "抢劫行为": "抢劫罪",
    "诈骗": "诈骗罪",
    "诈骗行为": "诈骗罪",
    "职务侵占罪": "职务侵占",
    "职务侵占行为": "职务侵占",
    "刑法264条": "刑法第二百六十四条",
    "第二百六十四条": "刑法第二百六十四条",
    "刑法263条": "刑法第二百六十三条",
    "第二百六十三条": "刑法第二百六十三条",
    "刑法266条": "刑法第二百六十六条",
    "第二百六十六条": "刑法第二百六十六条",
    "刑法272条": "刑法第二百七十二条",
    "第二百七十二条": "刑法第二百七十二条",
    "民法典577条": "民法典第五百七十七条",
    "第五百七十七条": "民法典第五百七十七条",
    "预期不履行": "预期违约",
    "违约赔偿": "损失赔偿",
    "股东出资": "股东出资义务",
    "董事勤勉": "董事勤勉义务",
    "暴力方式夺取财物": "抢劫罪",
    "持械抢夺财物": "抢劫罪",
    "虚构投资项目骗取钱款": "诈骗罪",
    "骗取钱款": "诈骗罪",
    "利用职务便利侵占单位财物": "职务侵占",
    "职务便利侵占": "职务侵占",
    "未按期缴纳出资": "股东出资义务",
    "按期缴纳出资": "股东出资义务",
    "迟延履行": "违约责任",
    "明确表示不履行主要债务": "预期违约",
    "明确表示不履行": "预期违约",
    "违约损失赔偿范围": "损失赔偿",
    "违约金明显过高": "违约金",
    "催告后承租人仍不付租金": "租赁合同",
    "连续三个月不付租金": "租赁合同",
    "董事违反勤勉义务": "董事勤勉义务",
    "股东未按期缴纳出资": "股东出资义务",
    "刑法第264条": "刑法第二百六十四条",
    "刑法第263条": "刑法第二百六十三条",
    "刑法第266条": "刑法第二百六十六条",
    "刑法第272条": "刑法第二百七十二条",
    "民法典第577条": "民法典第五百七十七条",
}
TRIPLE_ENTITY_TYPES = {
    "Crime": "LEGAL_CONCEPT",
    "LawArticle": "STATUTE",
    "Case": "CASE",
    "Court": "PARTY",
    "Circumstance": "LEGAL_CONCEPT",
    "Liability": "LEGAL_CONCEPT",
    "Party": "PARTY",
}
TRIPLE_RELATIONS = ["APPLIES_TO", "CITES", "HAS_CIRCUMSTANCE", "DECIDED_BY", "INVOLVES", "BEARS_LIABILITY"]

# --- retrieval and ranking ------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
HASH_BUCKETS = 384
TOP_K_RETRIEVAL = 50
TOP_K_FUSION = 50
COARSE_TOP_K = 20
RERANK_INPUT_K = 20
RERANK_TOP_K = 10
GRAPH_TOP_NODES = 10
GRAPH_TOP_EDGES = 20
RANK_WEIGHTS = {"semantic": 0.45, "vector": 0.2, "bm25": 0.15, "graph": 0.2}
BM25_SQUASH = 8.0
RELATION_PRIOR = {
    "APPLIES_TO": 1.0,
    "REFERENCES_STATUTE": 0.9,
    "CITES": 0.9,
    "INVOLVES_PARTY": 0.75,
    "MENTIONED_WITH": 0.6,
    "VECTOR_MATCH": 0.45,
}
RELATION_PRIOR_DEFAULT = 0.5

# --- question understanding -------------------------------------------------------
FOLLOWUP_WORDS = ["那如果", "这种情况", "那这个", "那没有", "如果对方", "那呢", "然后"]
QUESTION_TYPE_RULES = [
    # (any of, none of, question type)
    (FOLLOWUP_WORDS, [], "multiturn_followup"),
    (
        ["违约损失赔偿范围", "违约金明显过高", "赔偿范围一般包括哪些内容"],
        ["案例", "法院", "判决", "裁判"],
        "statute_lookup",
    ),
    (
        [
            "卖方", "买方", "承租人", "出租人", "房屋产权争议", "停工", "赔偿范围", "物权是否", "通常如何确定",
            "通常可以主张哪些救济", "可得利益", "未登记", "登记簿", "物权变动", "责任承担方式", "补救措施",
            "继续履行", "赔偿损失",
        ],
        [],
        "case_reasoning",
    ),
    (["案例", "判决", "裁判", "法院", "被告", "原告", "如何定性", "如何处理"], [], "case_reasoning"),
    (["适用哪一条", "法条", "条文", "第", "刑法", "民法典"], [], "statute_lookup"),
    (["是什么", "含义", "定义", "概念", "哪些要素", "怎么办"], [], "concept_definition"),
]
STRATEGY_RULES = [
    # (any of, and any of, none of, question type, strategy, reason)
    (
        ["主要债务", "预期违约", "约定违约金", "违约金明显过高"], [],
        ["案例", "判决", "裁判", "被告", "原告"], None,
        "graph", "规则命中法条归责先验，优先图检索。",
    ),
    (
        ["王某", "刘某", "陈某"], ["如何定性", "如何处理", "法律评价"], [], None,
        "vector", "规则命中个案事实定性问法，优先向量检索。",
    ),
    (
        ["侵权赔偿责任", "过错程度", "医疗费用"], [], [], None,
        "hybrid", "规则命中侵权责任认定问法，采用混合检索。",
    ),
    (
        ["你好", "你是谁", "介绍一下你", "这个项目是做什么的"], [], [], None,
        "direct_answer", "规则命中通用对话，直接回答。",
    ),
    (
        ["是什么", "含义", "定义", "概念", "what is"], [], [], None,
        "hybrid", "规则命中定义类问题，优先混合检索以补足法条与案例证据。",
    ),
    (
        ["责任承担方式", "补救措施", "继续履行", "赔偿损失", "可得利益", "物权变动", "不动产登记簿"], [], [], None,
        "hybrid", "规则命中责任方式/证据要点类问题，采用混合检索。",
    ),
    ([], [], [], "multiturn_followup", "hybrid", "题型先验命中多轮追问，采用混合检索。"),
    ([], [], [], "case_reasoning", "hybrid", "题型先验命中案例推理，采用混合检索。"),
    ([], [], [], "statute_lookup", "graph", "题型先验命中法条定位，优先图检索。"),
    (
        ["案例", "判决", "裁判", "分析", "为何", "如何认定", "争议焦点", "法院", "被告", "原告", "判令"], [],
        ["法条", "条文", "依据哪条", "第"], None,
        "vector", "规则命中纯案例问答，优先向量检索。",
    ),
    (
        ["案例", "判决", "裁判", "分析", "为何", "如何认定", "争议焦点", "法院", "被告", "原告", "判令"], [], [], None,
        "hybrid", "规则命中案例分析类问题，采用混合检索。",
    ),
    (
        ["适用哪一条", "法条", "条文", "第"], [], [], None,
        "graph", "规则命中法条适用/归责问题，优先图检索。",
    ),
    (
        [
            "怎么办", "如何处理", "如何承担", "是否可以", "能否", "那如果", "这种情况", "如何确定",
            "可以主张哪些救济", "赔偿范围", "可得利益", "未登记", "登记簿", "物权变动",
        ],
        [], [], None,
        "hybrid", "规则命中实务问答/追问模式，采用混合检索。",
    ),
]
STRATEGY_DEFAULT = ("graph", "规则未命中明确类型，默认图检索。")
ROUTES = {
    "vector": ("vector_retrieval", ["vector_search", "legal_article_lookup"]),
    "hybrid": ("hybrid_retrieval", ["case_lookup", "graph_search", "vector_search"]),
    "direct_answer": ("direct_answer", []),
    "graph": ("graph_reasoning", ["graph_search", "legal_article_lookup"]),
}
QUERY_EXPANSION = {
    "合同违约": ["违约责任", "损害赔偿", "继续履行", "解除合同"],
    "盗窃": ["盗窃罪", "刑法", "量刑", "数额"],
    "诈骗": ["诈骗罪", "刑法", "构成要件"],
    "租赁": ["租赁合同", "租金", "承租人", "出租人"],
    "侵权": ["侵权责任", "过错", "赔偿"],
}
SHORT_QUERY_HINTS = ["法律条款", "裁判要点"]
SHORT_QUERY_LENGTH = 10
SHORT_QUERY_EXEMPT = "法条|条文|责任|构成|要件"
DECOMPOSE_PATTERN = r"[，。；;]\s*|以及|并且|同时|和"
DECOMPOSE_WORDS = ["什么", "如何"]
REASONING_WORDS = ["why", "how", "because", "explain", "decide", "holding", "如何", "为什么"]

# --- rewrite gate ------------------------------------------------------------------
PRONOUN_WORDS = ["这个", "那个", "这种情况", "那如果", "如果这样", "那呢", "他", "她", "它"]
FOLLOWUP_STARTS = ["那", "那么", "然后", "如果", "这种", "这样", "那如果"]
LEGAL_ENTITY_HINTS = [
    "刑法", "民法典", "公司法", "劳动合同法", "盗窃", "诈骗", "违约", "侵权", "租赁", "买卖", "借贷", "法条", "条文",
]
DEPENDENT_WORDS = ["那", "这个", "这种", "如果", "上述", "该情形"]
STRONG_FOLLOWUP_WORDS = ["如果对方", "那没有登记", "那没有", "这种情况下", "明确说不履行"]
REWRITE_ENTITY_PATTERN = (
    f"(刑法第{NUMERAL_CLASS}+条|民法典第{NUMERAL_CLASS}+条|"
    "盗窃罪|抢劫罪|诈骗罪|违约责任|侵权责任|租赁合同|买卖合同|劳动争议|公司纠纷|股东出资义务|董事勤勉义务)"
)
REWRITE_TEMPLATES = {
    "refusal": "如果合同一方已经明确表示不履行主要债务，是否构成预期违约并应承担违约责任？",
    "expected_profit": "在合同违约导致损失的情况下，守约方是否可以主张可得利益赔偿，以及是否受可预见范围限制？",
    "registration": "在房屋买卖中未办理不动产登记时，物权是否已经发生变动，是否以不动产登记簿记载为准？",
}
REWRITE_LEAD_IN = "^(那如果|那么|如果|那这个|这个|这种情况|这种|那呢|然后)+"
REWRITE_TRIM = "，。！？? "

# --- grounding, citation, reflection, answer -------------------------------------------
CLAIM_SPLIT_PATTERN = "[。！？!?；;]|以及|并且|且|同时"
MAX_CLAIMS_PER_TEXT = 4
CLAIM_WEIGHTS = {"lexical": 0.55, "semantic": 0.45}
CLAIM_FLOOR = 0.03
CLAIM_TOP_K = 3
GROUNDING_WEIGHTS = {"lexical": 0.5, "semantic": 0.5}
GROUNDING_CLAIM_FLOOR = 0.08
GROUNDING_PASS = 0.12
MISSING_TOKENS_KEPT = 8
CITATION_ARTICLE_PATTERN = (
    f"(刑法|民法典|公司法|劳动合同法|劳动争议调解仲裁法)?第({NUMERAL_CLASS}+)条"
)
CASE_ID_PATTERN = "((?:\\(|（)?[0-9]{4}(?:\\)|）)?.{0,8}号)"
DOC_ID_LAW_PATTERN = "(law|statute)_(criminal|civil|company|labor|labour)_([0-9]{1,4})"
DOC_ID_BRANCHES = {"criminal": "刑法", "civil": "民法典", "company": "公司法"}
DOC_ID_BRANCH_DEFAULT = "劳动合同法"
CITATION_LAW_BACKFILL = ["刑法", "民法典", "公司法"]
EVIDENCE_ENTITY_PATTERN = f"(刑法第{NUMERAL_CLASS}+条|民法典第{NUMERAL_CLASS}+条)"
EVIDENCE_ENTITY_HINTS = [
    "盗窃罪", "抢劫罪", "诈骗罪", "职务侵占", "违约责任", "侵权责任", "租赁合同", "买卖合同", "可得利益",
    "补足出资", "勤勉义务", "举证责任", "不动产登记", "物权变动", "预期违约",
]
ANSWER_EVIDENCE_TERMS = [
    "违约责任", "侵权责任", "可得利益", "解除合同", "补足出资", "勤勉义务", "举证责任", "抢劫罪", "诈骗罪",
    "盗窃罪", "职务侵占", "预期违约", "不动产登记", "物权变动", "承担违约责任", "退赔", "刑事责任",
    "合理支出", "赔偿范围", "不动产登记簿", "发生效力",
]
ANSWER_QUERY_TERMS = [
    "盗窃罪", "抢劫罪", "诈骗罪", "职务侵占", "违约责任", "侵权责任", "租赁合同", "解除合同", "可得利益",
    "补足出资", "勤勉义务", "举证责任", "不动产登记", "物权变动", "预期违约", "承担违约责任",
]
ANSWER_BOOSTS = [
    # alternatives; each alternative is a list of groups that must all have a word in the query
    ([[["股东"], ["出资", "未按期缴纳"]]], ["补足出资", "承担责任", "公司法"]),
    ([[["职务便利"], ["私售", "侵占"]]], ["职务侵占", "退赔", "刑事责任"]),
    ([[["迟延交货"]], [["停工"], ["赔偿范围"]]], ["可得利益", "合理支出", "赔偿范围"]),
    ([[["连续三个月不付租金"]], [["不付租金"], ["救济"]]], ["解除合同", "欠付租金", "违约金"]),
    ([[["未登记", "没有登记"], ["物权", "产权", "房子"]]], ["登记", "物权变动", "不动产登记簿", "发生效力"]),
    ([[["可得利益"]]], ["可得利益", "可预见范围", "损失赔偿"]),
    ([[["明确说不履行", "不履行了呢"]]], ["预期违约", "承担违约责任"]),
    ([[["买卖合同"], ["责任承担方式"]]], ["继续履行", "补救措施", "赔偿损失"]),
]
CONCLUSION_WITH_EVIDENCE = "证据显示该问题可基于当前检索结果进行回答。"
CONCLUSION_WITHOUT_EVIDENCE = "证据不足，建议补充检索或改写问题。"
DIRECT_CONCLUSION = "该问题为通用咨询，已走直接回答路径。"
DIRECT_STEP = "该问题命中 direct_answer 分支，未触发检索。"
DIRECT_CONFIDENCE = 0.35
REFLECTION_WEIGHTS = {"coverage": 0.4, "consistency": 0.3, "depth": 0.3}
REFLECTION_THRESHOLD = 0.6
REFLECTION_MIN_STEPS = 2

# --- conversation memory ---------------------------------------------------------------
MEMORY_MAX_TURNS = 12
MEMORY_MAX_TOKENS = 1800
MEMORY_WINDOW = 6
SUMMARY_TURNS = 6
SUMMARY_TOKENS = 1000
TOKENS_PER_CHAR = 0.6
AMOUNT_PATTERN = "([0-9]+(?:\\.[0-9]+)?\\s*(?:元|万元|万|千元))"
TIME_PATTERN = "([0-9]{4}年(?:[0-9]{1,2}月)?(?:[0-9]{1,2}日)?)"
FACT_ALIASES = {"房东": "出租人", "租客": "承租人"}
FACT_EVENTS = ["盗窃罪", "诈骗罪", "违约责任", "侵权责任", "租赁纠纷", "劳动争议", "公司纠纷"]
FACT_EVENT_SUFFIX = "责任"
FACT_EVENT_ALIASES = {"盗窃": "盗窃罪", "诈骗": "诈骗罪", "违约": "违约责任", "侵权": "侵权责任"}
FACT_RELATIONS = ["租赁", "买卖", "借贷", "劳动", "侵权", "违约"]
FACT_ACTORS = ["张某", "李某", "王某", "甲公司", "乙公司", "某公司", "法院"]
FACT_ROLES = ["出租人", "承租人", "买方", "卖方", "劳动者", "用人单位"]
FACT_CONFIDENCE = {"empty": 0.35, "base": 0.45, "event": 0.2, "amount": 0.1, "time": 0.1, "actor": 0.1, "cap": 0.95}
SOURCE_RELIABILITY = {
    "statute": 1.0,
    "case": 0.9,
    "assistant_summary": 0.75,
    "assistant": 0.7,
    "user": 0.6,
    "unknown": 0.5,
}
FACT_SCORE_WEIGHTS = {"confidence": 0.55, "source": 0.3, "recency": 0.15}
FACT_UNCERTAIN_GAP = 0.05
SUMMARY_TOPICS = ["盗窃", "诈骗", "违约", "租赁", "侵权", "劳动", "公司", "买卖", "借贷"]
SUMMARY_NO_TOPIC = "未明确"
SUMMARY_ISSUES = ["责任", "赔偿", "证据", "构成要件", "违约", "过错", "损害", "解除"]
SUMMARY_LAWS = ["刑法", "民法典", "公司法", "劳动合同法"]
SUMMARY_CONFIDENCE = 0.55
SUMMARY_TO_FILL = "待补充"
SUMMARY_NONE_OPEN = "暂无"

# --- evaluation ------------------------------------------------------------------------
QUESTION_TYPES = ["statute_lookup", "concept_definition", "case_reasoning", "multiturn_followup"]
SOURCE_TYPES = ["statute_only", "case_only", "hybrid"]
CATEGORY_QUESTION_TYPES = [
    ("法条定位", "statute_lookup"),
    ("娉曟潯瀹氫綅", "statute_lookup"),
    ("案例支撑", "case_reasoning"),
    ("妗堜緥鏀拺", "case_reasoning"),
    ("多步推理", "case_reasoning"),
    ("澶氭鎺ㄧ悊", "case_reasoning"),
    ("multiturn", "multiturn_followup"),
    ("faq", "concept_definition"),
]
CATEGORY_SOURCE_TYPES = [
    ("法条定位", "statute_only"),
    ("娉曟潯瀹氫綅", "statute_only"),
    ("案例支撑", "case_only"),
    ("妗堜緥鏀拺", "case_only"),
    ("多步推理", "hybrid"),
    ("澶氭鎺ㄧ悊", "hybrid"),
    ("faq", "statute_only"),
]
METRICS = {
    "retrieval_hit_rate": "evidence_path_hit_rate",
    "answer_relevance": "answer_keyword_match_rate",
    "citation_correctness": "citation_correctness",
    "citation_coverage": "citation_coverage",
    "grounding_score": "grounding_score",
    "context_resolution_accuracy": "context_resolution_accuracy",
    "rewrite_trigger_accuracy": "rewrite_trigger_accuracy",
    "rewritten_query_quality": "rewritten_query_quality",
    "average_latency": "latency",
}
WORST_SAMPLE_WEIGHTS = {
    "answer_keyword_match_rate": 0.35,
    "evidence_path_hit_rate": 0.25,
    "citation_correctness": 0.2,
    "grounding_score": 0.2,
}
BOTTLENECK_METRICS = [
    ("retrieval", "retrieval_hit_rate"),
    ("answer_relevance", "answer_relevance"),
    ("citation", "citation_correctness"),
    ("grounding", "grounding_score"),
]

# --- failure feedback --------------------------------------------------------------------
FAILURE_RULES = [
    # (metric, comparison, threshold, reason)
    ("evidence_path_hit_rate", "<=", 0.0, "retrieval_zero_hit"),
    ("answer_keyword_match_rate", "<", 0.2, "low_answer_relevance"),
    ("citation_correctness", "<", 0.2, "citation_incorrect"),
    ("grounding_score", "<", 0.1, "low_grounding"),
]
RUNTIME_GROUNDING = 0.1
RUNTIME_CONFIDENCE = 0.35
INSUFFICIENT_WORDS = ["证据不足", "无法判断", "无法回答", "建议补充"]
TOPIC_HINTS = {
    "租赁": "租赁纠纷",
    "承租": "租赁纠纷",
    "出租": "租赁纠纷",
    "盗窃": "盗窃罪",
    "诈骗": "诈骗罪",
    "侵权": "侵权责任",
    "违约": "违约责任",
    "买卖": "买卖合同",
    "公司": "公司纠纷",
    "劳动": "劳动争议",
}
TOPIC_OTHER = "其他"
FAILURE_REASONS_TEXT = {
    "no_data": "图谱和向量均无可用证据，疑似知识库覆盖不足。",
    "retrieval_miss": "候选证据为空，疑似召回失败。",
    "ranking_empty": "候选证据存在但排序结果为空。",
    "ranking_ids": "存在排序结果但无有效证据ID，疑似排序链路映射问题。",
    "rewrite_error": "query 改写偏离上下文或未正确补全。",
    "reasoning_error": "证据存在但推理链条不稳定。",
    "answer_hallucination": "答案出现证据未支持内容。",
    "strategy_graph": "案例问题使用 graph 策略可能不合适。",
    "strategy_vector": "法条定位问题使用 vector 策略可能不合适。",
    "default": "召回命中不足。",
}
SUGGESTION_LAYERS = {
    "data_expansion_suggestion": "data",
    "cleaning_suggestion": "chunking",
    "rewrite_rule_suggestion": "rewrite",
    "retrieval_strategy_suggestion": "retrieval",
    "ranking_suggestion": "ranking",
}
LAYER_FAILURES = {
    "data": ["no_data"],
    "chunking": ["bad_chunking"],
    "rewrite": ["rewrite_error"],
    "retrieval": ["retrieval_strategy_error", "retrieval_miss"],
    "ranking": ["ranking_error"],
}
FAILURE_SEVERITY = {
    "no_data": 1.0,
    "bad_chunking": 0.9,
    "rewrite_error": 0.9,
    "retrieval_strategy_error": 0.8,
    "retrieval_miss": 0.8,
    "ranking_error": 0.7,
    "reasoning_error": 0.6,
    "answer_hallucination": 0.6,
}
PRIORITY_WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.4}
STATUS_WEIGHT = {"open": 1.0, "in_progress": 0.6, "closed": 0.0}
ACTION_WEIGHTS = {"priority": 0.5, "status": 0.2, "pressure": 0.3}
CANDIDATE_WORDS = {
    "faq": ["是什么", "怎么办", "流程", "可以吗", "通常由谁"],
    "statute": ["法条", "哪一条", "依据", "条文"],
    "case": ["案件", "法院", "责任认定", "案例"],
}
DATA_EXPANSION_REASON = "失败样本中 %s 出现 %d 次，知识覆盖可能不足。"
DATA_EXPANSION_HINT = "补充该主题法条/案例/FAQ，优先覆盖高频问法。"
STAGE_SUGGESTIONS = [
    # (failure types that trigger it, type, target, reason, priority, owner, hint)
    (
        ["bad_chunking"], "cleaning_suggestion", "chunking_rules",
        "检测到 bad_chunking 失败，建议优化法条/案例结构化切分。",
        "high", "ingestion_team", "调整按条/款/项与案情/法院认为切分策略。",
    ),
    (
        ["rewrite_error"], "rewrite_rule_suggestion", "ellipsis_and_followup_patterns",
        "rewrite_error 出现 %d 次，建议扩展追问改写规则。",
        "high", "conversation_team", "新增省略问法模式，并增强事实补全。",
    ),
    (
        ["retrieval_strategy_error"], "retrieval_strategy_suggestion", "router_strategy_rules",
        "retrieval_strategy_error 出现 %d 次，建议调整 graph/vector/hybrid 路由规则。",
        "medium", "retrieval_team", "按问题类型重设策略优先级并回归验证。",
    ),
    (
        ["ranking_error", "retrieval_miss"], "ranking_suggestion", "ranking_weights_and_topk",
        "检索/排序失败占比较高，建议调参 evidence ranking 与 rerank top-k。",
        "medium", "ranking_team", "按 source/question 分桶调权重与 top-k。",
    ),
]

# --- corpus quality ------------------------------------------------------------------------
LENGTH_LIMITS = {"statute": (40, 1200), "case": (60, 2000), "faq": (15, 500)}
NEAR_DUPLICATE_RATIO = 0.985
NEAR_DUPLICATE_JACCARD = 0.995

# Fixed texts of an answer.
EVIDENCE_NODE_HEADING = "Relevant entities:"
EVIDENCE_EDGE_HEADING = "Relevant graph relations:"
NOTE_CERTAIN = "不确定性较低。"
NOTE_SPARSE = "不确定性较高：检索证据可能不完整。"
NOTE_UNLINKED = "中等不确定性：部分目标实体未被链接。"
NOTE_UNGROUNDED = "证据落地性不足。"
NOTE_EVIDENCE_WORD = "证据"
NO_CITATIONS = "共0条引用；主要来源={}；法条=[]；案例=[]"
