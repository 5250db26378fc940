"""Default word lists, tables and patterns. Every operator takes them as parameters.

All values below are fixed values: they decide which results come out, and other lists give other results.
"""

# Reference number: issuer characters, bracket, year, bracket, number.
FORMAL_REF = r"([\x{4e00}-\x{9fff}]+[〔〈《（‘〚](?:19|20)\d{2}[〕〉》）’〛]\d+号)"
FORMAL_CORE = r"[〔〈《（‘〚](?:19|20)\d{2}[〕〉》）’〛]\d+号$"
NAMED_REF = r"《([^》]{8,100})》"
LEAD_IN = r"^(?:按照|依照|遵照|参照|对照|根据|依据|参见|详见|另见|结合|贯彻|落实|执行|适用|符合|违反|按|据|见)+"
ORG_MARKERS = "局厅委办部院府署会处站队团市省区县镇乡街道政"
HEAD_NOISE = r"的|关于|通知|意见|通报|决定|公告|办法|方案|表彰|调整|印发|转发|征收|批复|精神|国务院|人民政府|办公厅|[，、。；：（）“”]|[0-9]"
META_PREFIXES = ["依据", "依照"]

# Level -> prefixes of document numbers, tested in this order.
LEVEL_PREFIXES = {
    "central": ["国发", "国办", "国函", "中发", "中办", "发改", "国土资", "建市", "建房", "建科", "人社部", "国税", "财综", "财预", "财建", "环发", "银监", "工信部", "水资源"],
    "provincial": ["粤府", "粤办", "粤财", "粤价", "粤发", "粤卫", "粤环"],
    "municipal": ["深府", "深发", "深办", "深市", "深人", "深规土", "深建", "深前海"],
    "district": ["深坪", "深福", "深南", "深龙", "深宝", "深盐", "深光", "深罗"],
}
LEVEL_WEIGHTS = {"central": 3.0, "provincial": 2.0, "municipal": 1.5, "district": 1.0, "department": 1.0, "unknown": 0.5}

# Issuer by the longest prefix of the document number.
ISSUERS = {
    "国办公开办函": "General Office of State Council", "国办发明电": "General Office of State Council", "国办发": "General Office of State Council", "国办函": "General Office of State Council",
    "国发": "State Council (国务院)", "国函": "State Council (国务院)", "中办发": "CPC Central Committee Office", "中发": "CPC Central Committee",
    "发改": "NDRC (National)", "国土资厅发": "Ministry of Natural Resources", "国土资发": "Ministry of Natural Resources",
    "建市": "Ministry of Housing (MoHURD)", "建房": "Ministry of Housing (MoHURD)", "建科": "Ministry of Housing (MoHURD)", "人社部发": "Ministry of Human Resources",
    "国税发": "State Administration of Taxation", "财综": "Ministry of Finance", "财预": "Ministry of Finance", "财建": "Ministry of Finance",
    "环发": "Ministry of Ecology & Environment", "银监发": "Banking & Insurance Commission", "工信部联企业": "Ministry of Industry & IT", "水资源": "Ministry of Water Resources",
    "粤府办": "Guangdong Provincial Office", "粤府函": "Guangdong Provincial Government", "粤府": "Guangdong Provincial Government", "粤办发": "Guangdong Provincial Office", "粤办函": "Guangdong Provincial Office",
    "粤财综": "Guangdong Finance Dept", "粤财金": "Guangdong Finance Dept", "粤价": "Guangdong Pricing Bureau", "粤发": "Guangdong Provincial Party Committee", "粤卫": "Guangdong Health Commission", "粤环发": "Guangdong Ecology & Environment",
    "深府办规": "Shenzhen Municipal Office (Normative)", "深府办函": "Shenzhen Municipal Office (Letter)", "深府办": "Shenzhen Municipal Office", "深府规": "Shenzhen Municipal (Normative)", "深府函": "Shenzhen Municipal (Letter)", "深府": "Shenzhen Municipal Government",
    "深发": "Shenzhen CPC Committee", "深办发": "Shenzhen CPC Committee Office", "深办": "Shenzhen CPC Committee Office", "深规土": "Shenzhen Planning & Natural Resources", "深建规": "Shenzhen Housing & Construction",
    "深市监规": "Shenzhen Market Supervision", "深前海": "Qianhai Authority", "深人": "Shenzhen Human Resources",
    "深坪": "Pingshan District", "深光": "Guangming District", "深福": "Futian District", "深南": "Nanshan District", "深龙": "Longgang/Longhua District", "深宝": "Bao'an District", "深盐": "Yantian District", "深罗": "Luohu District",
    "依据粤府": "Guangdong Provincial Government", "依据国发": "State Council (国务院)", "依照国发": "State Council (国务院)",
}

POLICY_WORDS = ["方案", "措施", "意见", "通知", "规定", "规划", "条例", "办法", "纲要", "计划", "指南", "指引", "行动", "决定", "公告", "细则", "制度", "标准", "清单"]
NOT_POLICY_WORDS = ["白皮书", "报告", "讲话", "文章", "演讲", "论文"]
CENTRAL_NAMES = ["国务院", "国家", "全国", "中共中央", "教育部", "科技部", "工信部", "教育强国", "中小学"]
PROVINCIAL_NAMES = ["广东省", "省"]
DISTRICT_NAMES = ["龙华", "南山", "坪山", "福田", "罗湖", "宝安", "盐田", "光明", "龙岗", "大鹏"]

# Document type by title, first match wins.
DOC_TYPES = [
    (r"条例$", "regulation"), (r"办法$", "regulation"), (r"规定$", "regulation"), (r"规则$", "regulation"), (r"准则$", "regulation"), (r"细则$", "regulation"),
    (r"行动计划|行动方案", "action_plan"), (r"实施方案|实施意见|实施细则", "action_plan"), (r"发展规划|发展纲要|五年规划", "strategy"), (r"工作方案|工作计划|工作要点", "work_plan"),
    (r"关于印发.*的通知", "policy_issuance"), (r"补贴|资助|奖励|扶持|专项资金|引导基金", "subsidy"), (r"公示.*名单|公示.*项目|公示.*企业", "subsidy_list"), (r"申报.*指南|申报.*通知|申报.*公告", "application_guide"),
    (r"解读|一图读懂|图解|政策问答", "explainer"), (r"标准$|国家标准|行业标准|团体标准", "standard"), (r"公告$|通告$|公报$", "announcement"), (r"征求.*意见|意见征集|公开征求", "consultation"),
    (r"会议纪要|工作报告|工作总结|述职", "administrative"), (r"人事|任免|任命|聘任|招聘|录用", "personnel"), (r"批复$|函$", "reply"), (r"通知$", "notice"),
    (r"评论|社论|时评|锐评|快评|论坛|观察", "commentary"), (r"专访|访谈|对话", "interview"), (r"综述|述评|盘点|回顾", "review"),
]

# Relevance terms and weights.
AI_TERMS = {
    "人工智能": 10, "大模型": 9, "生成式人工智能": 10, "深度学习": 8, "机器学习": 8, "自然语言处理": 8, "计算机视觉": 7, "智能体": 8,
    "算力": 7, "数据中心": 7, "智算中心": 9, "GPU": 8, "算力券": 9,
    "半导体": 8, "芯片": 7, "集成电路": 7, "光刻": 9, "晶圆": 8, "EDA": 9,
    "自动驾驶": 7, "智能网联": 7, "无人机": 6, "机器人": 5, "具身智能": 9, "人形机器人": 9,
    "算法治理": 8, "算法备案": 9, "数据要素": 6, "数据安全": 5, "网络安全": 4, "个人信息保护": 5,
    "数字经济": 4, "数字化转型": 3, "新质生产力": 3, "智慧城市": 3, "区块链": 4, "量子计算": 6, "5G": 3, "云计算": 4, "物联网": 3,
}

AMOUNT_IN_CONTEXT = r"([^。；\n]{0,80})(\d+(?:\.\d+)?)\s*(万元|亿元)([^。；\n]{0,40})"
SECTORS = [
    "人工智能", "集成电路", "半导体", "芯片", "新能源", "新能源汽车", "光伏", "储能", "生物医药", "生命健康", "医疗器械", "数字经济", "数字化", "信息技术", "软件", "智能制造", "机器人", "高端装备",
    "新材料", "先进材料", "海洋经济", "海洋产业", "航空航天", "低空经济", "无人机", "5G", "量子", "区块链", "文化创意", "文化产业", "金融科技", "现代服务业", "绿色低碳", "节能环保", "现代农业", "总部经济",
]

TITLE_PUNCTUATION = r"[\s《》〈〉「」『』【】〔〕\[\]()（）“”‘’\"'、，,。．\.·・:：;；／/\x{3000}]"
TITLE_PREFIX = "中华人民共和国"
DOCNUM_PUNCTUATION = r"[\s〔〕\[\]()（）【】\x{3000}]"

# Career organisations: records that aren't posts, words that end an organisation, characters that it must have.
NOT_ORGS = ["加入中国共产党", "参加革命工作", "加入共青团", "出生", "生于", "学习", "毕业", "学位", "硕士", "博士", "研究生", "本科", "结婚", "去世", "逝世", "退休"]
POST_MARKERS = ["书记", "主任", "局长", "厅长", "部长", "委员", "代表", "省长", "市长", "县长", "主席", "委员长", "总理", "副"]
ORG_SIGNS = ["省", "市", "县", "区", "部", "委", "局", "院", "署", "办", "厅", "处", "国务院", "中央", "全国"]

# Career lines: three formats, what marks lines that aren't posts, and what ends an organisation's name.
CAREER_DOTTED = r"^(\d{4})\.(\d{1,2})-(\d{4})\.(\d{1,2})\s+(.+)"
CAREER_YEARS = r"^(\d{4})-(\d{4})年\s+(.+)"
CAREER_PROSE = r"^(\d{4})年(?:(\d{1,2})月)?[，,、\s—-]*(?:任|担任|兼任|调任|转任|升任|当选|出任|改任|晋升|被任命|受命|就任|授予|选举|聘为|提拔|调入|进入|赴|到|在)?\s*(.+?)(?=[。；;$\n]|(?=\d{4}年))"
NOT_POSTS = ["出生", "生于", "入学", "学习", "专业", "毕业", "学位", "结婚"]
ORG_END = r"^(.+?(?:省|市|区|县|部|委|局|院|署|办|厅|处|总|公司|集团|银行|大学|学院|工厂|军区|政府))\s*(.+)"
CAREER_WORDS = ["书记", "市长", "省长", "部长", "主任", "副"]
PROVINCES = [
    "北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南",
    "湖北", "湖南", "广东", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "台湾", "内蒙古", "广西", "西藏", "宁夏", "新疆",
]
CENTRAL_ORGS = [
    "国务院", "中央", "全国人大", "全国政协", "中共中央", "中纪委", "中央纪委", "中央军委", "国家", "最高人民法院", "最高人民检察院", "中国人民银行", "外交部", "国防部", "财政部", "商务部", "工信部",
    "教育部", "科技部", "公安部", "民政部", "司法部", "人社部", "自然资源部", "生态环境部", "住建部", "交通运输部", "水利部", "农业农村部", "文旅部", "卫健委", "退役军人事务部", "应急管理部", "审计署", "国资委", "市场监管总局", "发改委", "统计局",
]

# English label -> level, tests in order.
LABEL_LEVELS = [
    ("central", ["state council", "ministry", "national", "cpc central", "people's bank", "commission", "sasac", "administration"]),
    ("provincial", ["provincial", "province"]), ("municipal", ["municipal", "municipality"]), ("district", ["district"]), ("provincial", ["guangdong", "gd "]), ("municipal", ["shenzhen", "sz "]),
]

# Collections: focus tag by title (first match wins), words that speak of the country, tier by level.
FOCUS_TAGS = [("储备", "reserve"), ("霍尔木兹", "hormuz"), ("中方|外交部|中国|中企", "chinaresp"), ("进口|采购|抢购|供应", "import")]
CHINA_WORDS = ["中国", "中方", "外交部", "中企", "独立炼油", "人民币"]

# Frontier: which source reaches an issuer, first match wins.
REACH = [
    (r"^(国发|国办|国函|国转)", "State Council 国务院"), (r"^(中办|中发|中组|中宣|中编)", "CPC Central Committee"), (r"^财", "Ministry of Finance 财政部"), (r"^发改", "NDRC 发改委"), (r"^国卫", "National Health Commission 卫健委"),
    (r"^(民发|民函)", "Ministry of Civil Affairs 民政部"), (r"^银发", "People's Bank of China 央行"), (r"^国市监", "SAMR 市场监管总局"), (r"^(国科|科技)", "MOST 科技部"), (r"^(环发|环办|生态环境)", "MEE 生态环境部"),
    (r"^(人社部|人社)", "MOHRSS 人社部"), (r"^(国土资|自然资源|国土)", "MNR 自然资源部"), (r"^(工信|工业和信息化)", "MIIT 工信部"), (r"^(建|住建)", "MOHURD 住建部"),
    (r"^黑政", "Heilongjiang 黑龙江"), (r"^(粤)", "Guangdong province 广东"), (r"^(穗|广州)", "Guangzhou 广州"), (r"^(深|深圳)", "Shenzhen 深圳"), (r"^(苏|苏州)", "Suzhou/Jiangsu 苏州"), (r"^(京)", "Beijing 北京"),
    (r"^(沪)", "Shanghai 上海"), (r"^(渝)", "Chongqing 重庆"), (r"^(浙)", "Zhejiang 浙江"), (r"^(鄂|武)", "Hubei/Wuhan 湖北"),
    (r"^(珠|佛|莞|惠|中山|中府|江门|江府|江自|肇|茂|湛|汕|潮|揭|云浮|云府|阳|韶|梅|清远|河源|河府)", "Other Guangdong cities"),
]
