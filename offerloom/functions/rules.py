"""Rule tables of the catalogue: plain data, so that another domain can bring its own."""

from __future__ import annotations

# The names of categories with label and display order, and which of them are kept.
CATEGORIES = {
    "cpu": ("CPU 處理器", 1), "motherboard": ("主機板", 2), "gpu": ("顯示卡", 3), "ram": ("記憶體", 4), "ssd": ("固態硬碟 SSD", 5),
    "hdd": ("傳統硬碟 HDD", 6), "psu": ("電源供應器", 7), "case": ("機殼", 8), "cooler": ("散熱器", 9), "monitor": ("螢幕", 10),
    "fan": ("系統風扇", 11), "keyboard": ("鍵盤", 12), "mouse": ("滑鼠", 13), "headset": ("耳機 / 麥克風", 14), "speaker": ("喇叭 / 音響", 15),
    "network": ("網通設備", 16), "cable": ("線材", 17), "os": ("作業系統 / 軟體", 18), "package": ("整機 / 組合", 20), "other": ("其他", 99),
}
RETAINED = tuple(c for c in CATEGORIES if c != "other")
#: Display order of a category that the table does not name.
UNKNOWN_ORDER = 98
MIN_PRICE = 10

# Canonical brand names in order, and other spellings with their canonical name.
BRANDS = (
    "Intel", "AMD", "NVIDIA", "ASUS", "MSI", "GIGABYTE", "ASRock", "BIOSTAR",
    "Corsair", "G.SKILL", "Kingston", "Crucial", "TEAMGROUP", "ADATA", "Apacer", "Patriot", "Klevv",
    "Samsung", "WD", "Seagate", "Toshiba", "KIOXIA", "SanDisk", "Solidigm",
    "EVGA", "ZOTAC", "Sapphire", "PowerColor", "XFX", "PNY", "Leadtek", "Inno3D", "Palit", "Gainward", "GALAX", "COLORFUL", "Maxsun",
    "Seasonic", "FSP", "Cooler Master", "NZXT", "be quiet!", "Thermaltake", "Antec", "SilverStone", "Montech", "In Win",
    "Lian Li", "Fractal Design", "Phanteks", "JONSBO", "TRYX", "XPG", "視博通", "Power Master", "幾何未來",
    "Cougar", "HYTE", "SAMA", "Super Flower", "旋剛", "SADES", "XIGMATEK", "YAMA", "Enermax",
    "Apexgaming", "TrendSonic", "Infotec", "Mavoly", "i-COOLTW", "TREETOP", "ALL-IN", "ZALMAN",
    "Ripple", "BitFenix", "EPONTEC", "GAMEMAX", "INFINITE", "1st Player", "電鎧",
    "Noctua", "Arctic", "DeepCool", "ID-COOLING", "Thermalright", "Delta",
    "BenQ", "ViewSonic", "DELL", "LG", "Acer", "AOPEN", "AOC", "Philips", "HP", "Lenovo", "VAIO", "Altos",
    "Logitech", "Razer", "SteelSeries", "HyperX", "darkFlash",
    "i-Rocks", "Cherry", "Keychron", "Rapoo", "Havit", "Turtle Beach", "EndGame Gear", "A4Tech", "Ducky", "AKKO", "Pulsar", "Lamzu", "Fantech",
    "Glorious", "Ktnet", "AULA", "UMAX", "Biwin",
    "EPOS", "Edifier", "Pioneer", "AIWA", "ATake", "Creative", "Sony", "JBL", "Bose", "Klipsch", "Audio-Technica", "Sennheiser", "Yamaha", "i.shock",
    "TP-Link", "Netgear", "Ubiquiti", "D-Link", "Synology", "QNAP", "Mercusys", "Zyxel", "AverMedia", "TOTOLINK", "Tenda", "Cudy", "Edimax", "TRENDnet",
    "Microsoft", "Apple", "ZhiTai",
)
BRAND_ALIASES = {
    "WESTERN DIGITAL": "WD", "WD_BLACK": "WD", "威剛": "ADATA", "十銓": "TEAMGROUP", "T-FORCE": "TEAMGROUP", "宇瞻": "Apacer", "美光": "Crucial",
    "MICRON": "Crucial", "東芝": "Toshiba", "金士頓": "Kingston", "影馳": "GALAX", "撼訊": "PowerColor", "藍寶": "Sapphire", "藍寶石": "Sapphire",
    "七彩虹": "COLORFUL", "銘瑄": "Maxsun", "麗臺 NVIDIA": "Leadtek", "LEADTEK 麗臺": "Leadtek", "麗臺": "Leadtek", "微星": "MSI", "華碩": "ASUS",
    "技嘉": "GIGABYTE", "華擎": "ASRock", "映泰": "BIOSTAR", "海盜船": "Corsair", "酷碼": "Cooler Master", "聯力": "Lian Li", "喬思伯": "JONSBO",
    "芝奇": "G.SKILL", "希捷": "Seagate", "三星": "Samsung", "群暉": "Synology", "威聯通": "QNAP", "水星": "Mercusys", "大飛": "darkFlash",
    "羅技": "Logitech", "雷蛇": "Razer", "致態": "ZhiTai", "曜越": "Thermaltake", "迎廣": "In Win", "安鈦克": "Antec", "亞碩": "Power Master",
    "銀欣": "SilverStone", "全漢": "FSP", "海韻": "Seasonic", "台達": "Delta", "DELTA": "Delta", "利民": "Thermalright", "佰維": "Biwin",
    "BIWIN": "Biwin", "廣鐸": "Ktnet", "KTNET": "Ktnet", "振華": "Super Flower", "富鈞": "XIGMATEK", "美洲獅": "Cougar", "先馬": "SAMA",
    "賽德斯": "SADES", "雅瑪": "YAMA", "保銳": "Enermax", "艾湃": "Apexgaming", "翰欣": "TrendSonic", "英富達": "Infotec", "松聖": "Mavoly",
    "樹昌": "TREETOP", "火鳥": "BitFenix", "櫻桃": "Cherry", "雷柏": "Rapoo", "海威特": "Havit", "艾芮克": "i-Rocks", "IROCKS": "i-Rocks",
    "雙飛燕": "A4Tech", "漫步者": "Edifier", "先鋒": "Pioneer", "愛華": "AIWA", "森海塞爾": "Sennheiser", "鐵三角": "Audio-Technica",
    "合勤": "Zyxel", "圓剛": "AverMedia", "訊舟": "Edimax", "TOTO-LINK": "TOTOLINK", "惠普": "HP", "聯想": "Lenovo", "宏碁": "Acer",
}

# Colours, long names first, as they are written and as they are shown or compared.
COLOUR_CATEGORIES = ("gpu", "keyboard", "mouse", "cooler", "case", "fan", "headset", "speaker", "monitor")
SHOWN_COLOURS = (
    ("星空藍", "星空藍"), ("奶咖色", "奶咖色"), ("焦糖色", "焦糖色"), ("夢幻粉", "夢幻粉"), ("電光藍", "電光藍"), ("桃紅|桃色|粉紅|粉色|PINK", "粉色"),
    ("石墨黑|BLACK|黑色", "黑色"), ("雪霧白|星光白|WHITE|白色", "白色"), ("海神藍|藍色|BLUE", "藍色"), ("紅色|RED", "紅色"), ("綠色|GREEN", "綠色"),
    ("黃色|YELLOW", "黃色"), ("紫色|PURPLE", "紫色"), ("灰色|GRAY|GREY", "灰色"), ("銀色|SILVER", "銀色"),
)
COMPARED_COLOURS = (
    ("電光藍", "electric blue"), ("桃紅|桃色|粉紅|粉色|PINK", "pink"), ("石墨黑|黑色|BLACK", "black"), ("雪霧白|星光白|白色|WHITE", "white"),
    ("藍色|BLUE", "blue"), ("紅色|RED", "red"), ("綠色|GREEN", "green"), ("黃色|YELLOW", "yellow"), ("紫色|PURPLE", "purple"),
    ("灰色|GRAY|GREY", "gray"), ("銀色|SILVER", "silver"),
)
# Fixed value: switches of keyboards, longer names first.
KEYBOARD_SWITCHES = "靜音紅軸|靜音茶軸|矮紅軸|矮茶軸|紅軸|茶軸|青軸|銀軸|黑軸|白軸|黃軸|綠軸|紫軸"

# Words that a cleaned name loses.  (pattern, ignore case), in order; each match becomes a space.
NAME_NOISE = (
    (r"<[^>]+>", False),
    (r"《[^》]*》", False), (r"【[^】]*】", False), (r"〈[^〉]*〉", False), (r"（[^）]*）", False), (r"\([^)]*\)", False), (r"［[^］]*］", False), (r"\[[^\]]*\]", False),
    (r"NT\$\s*[\d,]+", True), (r"\$\s*[\d,]+", False), (r"[\d,]+\s*元", False),
    (r"[↘↗↓↑★☆●◆◇■□▲△▽▼✦✧➤«»~]", False),
    (r"任搭\s*\d*|搭到\s*\d+|搭\s*\d+\s*元?省|搭機價|限組裝|組裝價", False),
    (r"熱賣|限量|限時|促銷|特價|下殺|爆殺|破盤|清倉|現省[\d,]*|省下?[\d,]+元?|免運|預購|現貨|缺貨|到貨|超值|優惠|福利品|拆封品?|展示機?|客訂|洽門市|洽小編|代理公司貨|公司貨|代理盒裝|盒裝|彩盒|平輸|水貨|終身保固|終身|全球保固|原廠保固|保固|代理商?[\d一二三四五六七八九十]+年|[\d一二三四五六七八九十]+年保固?|註冊?[\d一二三四五六七八九十]+年|吊卡式?", False),
)
# Fixed value: where the technical part of a name begins.
SPEC_MARKER = r"\d+\s*核|\d+(?:\.\d+)?\s*GHz|\bTurbo\b|讀\s*[:取]?\s*\d|寫\s*[:入]?\s*\d|std\s*:|[單雙三四五六]?\s*風扇|導管|液晶|\d+(?:\.\d+)?\s*cm|[長高厚寬]\s*[:：]?\s*\d|\/"

# Product lines that keep memory and disk keys apart, specific names first.
RAM_LINES = (
    (r"FURY\s*BEAST|獸獵者", "FURYBEAST"), (r"FURY\s*RENEGADE|RENEGADE|叛徒", "RENEGADE"), (r"FURY\s*IMPACT|IMPACT", "IMPACT"), (r"TRIDENT\s*Z5|幻鋒戟", "TRIDENTZ5"),
    (r"TRIDENT|三叉戟", "TRIDENT"), (r"RIPJAWS|焰刃", "RIPJAWS"), (r"VENGEANCE|復仇者", "VENGEANCE"), (r"DOMINATOR|統治者", "DOMINATOR"),
    (r"T-?CREATE\s*EXPERT", "TCREATEEXPERT"), (r"DELTA", "DELTA"), (r"VULCAN|火神", "VULCAN"), (r"LANCER\s*BLADE", "LANCERBLADE"), (r"LANCER", "LANCER"),
    (r"CLASSIC", "CLASSIC"), (r"CRUCIAL\s*PRO|美光PRO", "CRUCIALPRO"),
)
HDD_SERIES = (
    (r"IRONWOLF\s*PRO|那嘶狼\s*PRO", "IRONWOLFPRO"), (r"IRONWOLF|那嘶狼", "IRONWOLF"), (r"FIRECUDA|金梭魚", "FIRECUDA"), (r"BARRACUDA|梭魚", "BARRACUDA"),
    (r"SKYHAWK\s*AI|監控鷹\s*AI", "SKYHAWKAI"), (r"SKYHAWK|監控鷹", "SKYHAWK"), (r"EXOS", "EXOS"), (r"紅標\s*PLUS|RED\s*PLUS", "REDPLUS"),
    (r"紅標\s*PRO|RED\s*PRO", "REDPRO"), (r"紅標|WD\s*RED", "RED"), (r"紫標\s*PRO|PURPLE\s*PRO", "PURPLEPRO"), (r"紫標|PURPLE", "PURPLE"),
    (r"金標|WD\s*GOLD", "GOLD"), (r"黑標|WD\s*BLACK", "BLACK"), (r"藍標|WD\s*BLUE", "BLUE"), (r"P300", "P300"), (r"X300", "X300"), (r"N300", "N300"),
    (r"S300", "S300"), (r"L200", "L200"),
)
# Fixed value: part numbers of three disk makers.
HDD_PART_NUMBER = r"\b(ST\d{4,5}[A-Z]{2}\d{3}[A-Z0-9]{0,3}|WD\d{2,4}[A-Z]{4,5}|HDW[A-Z]{1,2}\d{2,4}[A-Z]{2,6})\b"

# Processor models, in the order in which they are tried: (pattern, prefix of the model).
CPU_MODELS = (
    (r"\b(?:Core\s*)?i([3579])[\s-]?(\d{4,5})([A-Z]{0,2})\b", "I"),
    (r"\bUltra\s*([3579])\s*(\d{3})([A-Z]{0,2})\b", "ULTRA"),
    (r"\b(?:Ryzen|R)\s*([3579])\s*[-\s]?(\d{4})([A-Z0-9]{0,3})\b", "RYZEN"),
)

# Words by which a listing says it is sold out, and markers of a price change, in order.
SOLD_OUT = ("缺貨", "停售", "售完")
PRICE_MARKERS = ((("↘", "降"), "down"), (("↗", "漲"), "up"), (("新品", "NEW"), "new"))
