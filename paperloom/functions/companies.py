"""Companies as papers name them in affiliations."""

from __future__ import annotations

# ---- fixed values: company, patterns of its names and mail domains (case as written) ------------
COMPANIES = {
    "Google": [r"\bGoogle\b", r"\bDeepMind\b", r"\bWaymo\b", r"@google\.com", r"@deepmind\.com"],
    "Meta": [r"\bMeta AI\b", r"\bMeta FAIR\b", r"\bMeta Reality Labs\b", r"\bReality Labs\b", r"\bMeta Platforms\b",
             r"\bFacebook\b", r"\bFAIR\b", r"@fb\.com", r"@meta\.com", r"\bMeta\s*(?:\\\\|,|\}|$)"],
    "Microsoft": [r"\bMicrosoft\b", r"\bMSRA\b", r"@microsoft\.com"],
    "NVIDIA": [r"\bNVIDIA\b", r"\bNvidia\b", r"@nvidia\.com"],
    "Amazon": [r"\bAmazon\b", r"\bAWS AI\b", r"@amazon\.com"],
    "Apple": [r"\bApple Inc\b", r"\bApple\s*(?:\\\\|,|\}|$)", r"@apple\.com"],
    "IBM": [r"\bIBM\b"],
    "Intel": [r"\bIntel Labs\b", r"\bIntel Corporation\b", r"\bIntel\s*(?:\\\\|,|\}|$)", r"@intel\.com"],
    "Adobe": [r"\bAdobe\b"],
    "Salesforce": [r"\bSalesforce\b"],
    "OpenAI": [r"\bOpenAI\b(?![- ]?(?:compatible|API|model))"],
    "Samsung": [r"\bSamsung\b"],
    "Sony": [r"\bSony\b"],
    "Qualcomm": [r"\bQualcomm\b"],
    "Honda Research Institute": [r"\bHonda Research\b"],
    "Toyota": [r"\bToyota Research Institute\b", r"\bToyota Motor\b", r"\bToyota InfoTech\b", r"\bToyota Central R", r"\bWoven\b"],
    "Bosch": [r"\bBosch\b"],
    "Hyundai": [r"\bHyundai\b"],
    "MERL": [r"\bMitsubishi Electric\b", r"\bMERL\b"],
    "NAVER": [r"\bNAVER\b", r"\bNaver Labs\b"],
    "LG AI Research": [r"\bLG AI\b", r"\bLG Electronics\b"],
    "Disney Research": [r"\bDisney Research\b"],
    "Boston Dynamics": [r"\bBoston Dynamics\b"],
    "Hugging Face": [r"\bHugging ?Face\b(?! (?:model|hub|transformers))"],
    "ByteDance": [r"\bByte[Dd]ance\b", r"\bTikTok\b", r"\bDouyin\b", r"@bytedance\.com"],
    "Alibaba": [r"\bAlibaba\b", r"\bDAMO Academy\b", r"\bQwen Team\b", r"\bTongyi\b", r"\bAnt Group\b", r"\bAMAP\b",
                r"\bAmap\b", r"@alibaba-inc\.com", r"@antgroup\.com"],
    "Tencent": [r"\bTencent\b", r"@tencent\.com"],
    "Baidu": [r"\bBaidu\b", r"@baidu\.com"],
    "Huawei": [r"\bHuawei\b", r"\bNoah'?s Ark\b", r"@huawei\.com"],
    "Xiaomi": [r"\bXiaomi\b", r"@xiaomi\.com"],
    "SenseTime": [r"\bSense[Tt]ime\b", r"@sensetime\.com"],
    "Megvii": [r"\bMegvii\b", r"\bMEGVII\b", r"\bFace\+\+"],
    "JD": [r"\bJD Explore\b", r"\bJD\.com\b", r"\bJD Research\b"],
    "Meituan": [r"\bMeituan\b"],
    "Kuaishou": [r"\bKuaishou\b", r"\bKwai\b"],
    "DiDi": [r"\bDiDi\b", r"\bDidi Chuxing\b"],
    "Lenovo": [r"\bLenovo\b"],
    "OPPO": [r"\bOPPO\b"],
    "vivo": [r"\bvivo (?:AI|Mobile|Communication)\b"],
    "Horizon Robotics": [r"\bHorizon Robotics\b"],
    "Unitree": [r"\bUnitree\b(?! (?:Go|H1|G1|B2|A1))"],
    "AgiBot": [r"\bAgi[Bb]ot\b", r"\bZhiyuan Robotics\b"],
    "Galbot": [r"\bGalbot\b", r"@galbot\.com"],
    "Li Auto": [r"\bLi Auto\b"],
    "XPeng": [r"\bXPeng\b", r"\bXpeng\b"],
    "NIO": [r"\bNIO Inc\b"],
    "Geely": [r"\bGeely\b"],
    "iFlytek": [r"\biFLYTEK\b", r"\biFlytek\b"],
    "Zhipu AI": [r"\bZhipu\b"],
    "DeepSeek": [r"\bDeepSeek-AI\b", r"\bDeepSeek AI\b"],
    "China Mobile": [r"\bChina Mobile\b"],
    "China Telecom": [r"\bChina Telecom\b", r"\bTeleAI\b"],
    "Midea": [r"\bMidea\b"],
    "Hikvision": [r"\bHikvision\b"],
    "UBTech": [r"\bUBTECH\b", r"\bUBTech\b"],
    "Ping An": [r"\bPing An\b"],
    "Hon Hai (Foxconn)": [r"\bFoxconn\b", r"\bHon Hai\b"],
    "Uber": [r"\bUber ATG\b", r"\bUber AI\b"],
}
# -------------------------------------------------------------------------------------------------

#: (company, pattern) rows, as ``functions.text.companies_in`` takes them.
PATTERNS = [(name, pattern) for name, patterns in COMPANIES.items() for pattern in patterns]
