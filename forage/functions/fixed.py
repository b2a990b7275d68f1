"""Word lists, lookup tables, patterns and constants.

These are plain data whose exact content decides the results (dictionary
forms, rule patterns, weights, code tables).  All of them have a small size
known when the code is written, so they enter query plans as literals and
never as a join side.
"""

# --- fixed values: diet labels and their synonym forms, canonical -> forms ---
DIET_SYNONYMS = {
    "vegan": ["plant-based", "plant based", "no animal", "pure vegetarian", "纯素", "全素", "纯植物"],
    "vegetarian": ["veggie", "no meat", "meat free", "素食", "素菜", "吃素", "斋菜"],
    "halal": ["halal certified", "muslim friendly", "清真", "穆斯林", "真主", "清真认证"],
    "kosher": ["kosher certified", "jewish food", "犹太", "洁食"],
    "organic": ["organic food", "organically grown", "有机", "有机食品", "有机食材"],
    "gluten-free": ["gluten free", "no gluten", "celiac safe", "wheat free", "无麸质", "无小麦", "不含麸质", "无麦"],
    "dairy-free": ["dairy free", "no dairy", "no milk", "lactose free", "lactose intolerant", "无乳制品", "无牛奶", "不含乳", "无乳糖"],
    "nut-free": ["nut free", "no nuts", "无坚果", "不含坚果"],
    "shellfish-free": ["no shellfish", "shellfish free", "无贝类", "无海鲜贝壳", "不含贝类"],
    "soy-free": ["soy free", "no soy", "无大豆", "不含大豆", "无豆制品"],
    "low-carb": ["low carb", "low carbohydrate", "carb free", "low sugar", "低碳", "低碳水", "低糖", "少碳水"],
    "keto": ["ketogenic", "keto friendly", "keto diet", "生酮", "生酮饮食", "酮体"],
    "high-protein": ["high protein", "protein rich", "protein packed", "高蛋白", "高蛋白质", "增肌餐", "健身餐"],
    "low-calorie": ["low calorie", "low cal", "light meal", "diet food", "低热量", "低卡", "减脂餐", "清淡"],
    "low-sodium": ["low sodium", "low salt", "no salt added", "低盐", "低钠", "少盐", "无盐添加"],
}

# --- fixed values: stopwords -------------------------------------------------
STOPWORDS_EN = (
    "a an the is are was were be been being have has had do does did will would shall should may might "
    "must can could i me my we our you your he she it they them their this that these those in on at to "
    "for of with by from as into about through during before after above below between some any each "
    "every all both few more most other than then when where while how what which who find get show tell "
    "want need looking please help near nearby around restaurant restaurants place places food eat eating "
    "good best"
).split()
STOPWORDS_ZH = (
    "的 了 和 是 在 我 有 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 们 来 他 她 它 已经 "
    "啊 哦 吧 呢 嗯 哈 哇 嗯嗯 好的 我想 我要 帮我 请问 找一下 找 想要 想 需要 附近 周边"
).split()

# --- fixed values: spelling vocabulary; order decides ties -------------------
SPELL_VOCABULARY = [
    "vegan", "vegetarian", "halal", "kosher", "organic",
    "gluten", "gluten-free", "dairy", "dairy-free", "lactose",
    "keto", "ketogenic", "protein", "high-protein", "low-carb",
    "calorie", "low-calorie", "sodium", "low-sodium",
    "nut-free", "shellfish", "soy-free",
    "restaurant", "food", "healthy", "diet",
]
SPELL_MAX_DISTANCE = 2

# --- fixed values: label rules as (pattern, label) ---------------------------
ALLERGEN_RULES = [
    ("花生|peanut", "peanut"),
    ("坚果|核桃|腰果|杏仁|nut", "tree_nut"),
    ("牛奶|乳制品|奶酪|cheese|dairy|milk|lactose", "dairy"),
    ("麸质|小麦|面筋|gluten|wheat", "gluten"),
    ("海鲜|虾|蟹|贝类|shellfish|shrimp|crab", "shellfish"),
    ("大豆|豆腐|soy|tofu", "soy"),
    ("鸡蛋|egg", "egg"),
    ("芝麻|sesame", "sesame"),
]
ALLERGEN_FREE_RULES = [
    ("无花生|不含花生|peanut.free", "peanut"),
    ("无麸质|无小麦|gluten.free", "gluten"),
    ("无乳糖|无奶|dairy.free|lactose.free", "dairy"),
    ("无大豆|soy.free", "soy"),
    ("无坚果|nut.free", "tree_nut"),
]
DIET_RULES = [
    ("纯素|全素|vegan|植物性|plant.based", "vegan"),
    ("素食|vegetarian|素", "vegetarian"),
    ("清真|halal|穆斯林", "halal"),
    ("犹太|kosher", "kosher"),
    ("有机|organic", "organic"),
    ("无麸质|gluten.free", "gluten-free"),
    ("无乳|dairy.free|lactose.free", "dairy-free"),
    ("生酮|keto|ketogenic", "keto"),
    ("高蛋白|high.protein", "high-protein"),
    ("低碳|low.carb", "low-carb"),
    ("低卡|低热量|low.cal", "low-calorie"),
    ("低钠|low.sodium", "low-sodium"),
    ("无坚果|nut.free", "nut-free"),
    ("无贝类|shellfish.free", "shellfish-free"),
    ("无大豆|soy.free", "soy-free"),
]

# --- fixed values: ranking weights per sort mode -----------------------------
# ``personalization`` is part of every mode but takes no part in the score.
SORT_MODES = {
    "default": {"text": 0.40, "diet": 0.30, "rating": 0.15, "distance": 0.10, "personalization": 0.05},
    "diet_first": {"text": 0.20, "diet": 0.60, "rating": 0.10, "distance": 0.05, "personalization": 0.05},
    "rating_first": {"text": 0.30, "diet": 0.20, "rating": 0.40, "distance": 0.05, "personalization": 0.05},
    "distance_first": {"text": 0.30, "diet": 0.20, "rating": 0.10, "distance": 0.35, "personalization": 0.05},
}
DISTANCE_SCALE_KM = 2.0
EARTH_RADIUS_KM = 6371.0

# --- fixed values: retrieval -------------------------------------------------
FIELD_BOOSTS = {"name": 3.0, "description": 2.0, "cuisine_type": 1.0, "address": 1.0}
BM25_K1 = 1.2
BM25_B = 0.75
MIN_MATCH_PERCENT = 60
FACET_SIZES = {"diet_labels": 20, "price_level": 5, "cuisine_type": 20}

# --- fixed values: map-feature cuisine codes and city boxes ------------------
CUISINE_NAMES = {
    "chinese": "中餐",
    "japanese": "日料",
    "korean": "韩餐",
    "thai": "泰餐",
    "vietnamese": "越南菜",
    "indian": "印度菜",
    "italian": "意餐",
    "pizza": "比萨",
    "burger": "汉堡",
    "sushi": "寿司",
    "noodles": "面食",
    "dumpling": "饺子/点心",
    "hot_pot": "火锅",
    "barbecue": "烧烤",
    "vegan": "纯素",
    "vegetarian": "素食",
    "halal": "清真",
    "regional": "地方菜",
    "international": "国际料理",
}
DEFAULT_CUISINE = "餐厅"
CUISINE_DIET_LABELS = {
    "vegan": ["vegan", "vegetarian"],
    "vegetarian": ["vegetarian"],
    "halal": ["halal"],
}
DIET_TAG_LABELS = {
    "diet:vegan": "vegan",
    "diet:vegetarian": "vegetarian",
    "diet:halal": "halal",
    "diet:gluten_free": "gluten-free",
    "diet:organic": "organic",
}
# south, west, north, east
CITY_BOXES = {
    "beijing": (39.75, 116.10, 40.20, 116.70),
    "shanghai": (31.00, 121.20, 31.50, 121.70),
    "guangzhou": (22.90, 113.10, 23.40, 113.65),
    "shenzhen": (22.45, 113.75, 22.80, 114.45),
    "chengdu": (30.45, 103.90, 30.85, 104.40),
    "hangzhou": (29.95, 119.95, 30.50, 120.50),
}
DEFAULT_CITY = "beijing"

# --- fixed values: refresh plan and throttle ---------------------------------
REFRESH_CITIES = ["beijing", "shanghai", "guangzhou", "shenzhen", "chengdu"]
REFRESH_KEYWORDS = [
    "素食", "纯素", "清真", "有机", "无麸质",
    "健康餐", "沙拉", "轻食", "火锅", "日料",
    "韩餐", "泰餐", "越南菜", "寿司",
    "vegan", "halal", "gluten free",
]
REFRESH_FIRST_SECONDS, REFRESH_INTERVAL_SECONDS = 30, 3600
UNDERSERVED_BELOW = 5
TRIGGER_LOCK_SECONDS = 300
TRIGGER_INGEST_CAP = 30
ESTIMATE_TTL_DAYS = 7

# --- fixed values: domains and display names ---------------------------------
DIET_LABEL_NAMES = {
    "vegan": "纯素",
    "vegetarian": "素食",
    "halal": "清真",
    "kosher": "犹太洁食",
    "organic": "有机",
    "gluten-free": "无麸质",
    "dairy-free": "无乳制品",
    "keto": "生酮",
    "high-protein": "高蛋白",
    "low-carb": "低碳水",
    "low-calorie": "低卡",
    "low-sodium": "低钠",
    "nut-free": "无坚果",
    "shellfish-free": "无贝类",
    "soy-free": "无大豆",
}
PRICE_LEVEL_NAMES = {1: "¥ 经济", 2: "¥¥ 实惠", 3: "¥¥¥ 中档", 4: "¥¥¥¥ 高档"}
MEAL_NAMES = {"breakfast": "早餐", "lunch": "午餐", "dinner": "晚餐", "snack": "加餐"}
# allergen names as shown in a warning
ALLERGEN_NAMES = {
    "peanut": "花生",
    "tree_nut": "坚果",
    "dairy": "乳制品",
    "gluten": "麸质",
    "shellfish": "贝类",
    "soy": "大豆",
    "egg": "鸡蛋",
    "sesame": "芝麻",
}
DAILY_REFERENCE = {"calories": 2000, "protein_g": 60, "fat_g": 65, "carb_g": 300}

# the two map-service variants
POI_VARIANTS = {
    "official": {"prefix": "gaode_", "source": "gaode", "photos": 5, "no_category": "", "keep_unnamed": True, "page": 25},
    "web": {"prefix": "amap_", "source": "amap_web", "photos": 4, "no_category": "餐厅", "keep_unnamed": False, "page": 20},
}

# element types of the amenities that a selection takes
AROUND_KINDS = {"restaurant": ("node", "way"), "cafe": ("node",), "fast_food": ("node",)}
BOX_KINDS = {"restaurant": ("node", "way"), "cafe": ("node",)}
