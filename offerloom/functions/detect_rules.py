"""What a title is, and what it is not: rule tables.

A rule is a list of clauses, any of which suffices; a clause is one condition
or a tuple of conditions that must all hold.  A condition is a pattern that the
title holds, whatever the case; ``!`` negates it, ``@name`` is another rule.
``~`` looks at the title without plus signs that join nothing, ``=`` at that
without what is built in, ``^`` at the trimmed title, ``usb`` at the title with
the numbers behind USB tied to it.
"""

from __future__ import annotations

from offerloom.functions import rules as R

# All patterns and words below, in order.
CPU_NAME = r"Ryzen\s*(AI\s*)?[3579]|Core\s*(Ultra\s*)?[3579]|Core\s*[3579]\s*\d{2,3}H|Core\s*Ultra|\bC[3579][\s-]?\d{3}H\b|\b[ui][3579][\s-]?\d{3,5}[A-Z0-9]{0,3}|\bR[3579][\s-]?\d{3,4}[A-Z0-9]{0,4}|Ultra\s*[3579][\s-]?\d|Threadripper|\bN[12]\d{2}\b|\bG\d{4}\b"
STORAGE = r"\b\d{3}\s?G(?:B)?\b|\b\d\s?T(?:B)?\b|\bSSD\b|512G|PCIe|M\.2"
GPU_NAME = r"\b(?:RTX|GTX)\s?\d{3,4}(?:\D|$)|\bGT\s?(?:1030|730|710|210)(?:\D|$)|\bRX\s?(?:[4-9]\d{3}|[456]\d{2})(?:\D|$)|\bArc\s?[AB]\d{3}(?:\D|$)"
CHIPSET = r"\b(?:Z890|W890|W880|Z790|W790|B860|B760|H810|H610|W680|B660|H510|H310|H110|H81|X870E|X870|WRX90|TRX50|WRX80|B850|B840|X670E|X670|B650E|B650|A620|B550|A520)[A-Z-]*\b"
FAN_SIZE = r"(?:^|\D)(?:80|92|120|140)(?:\D|$)|[89]\s*CM|1[24]\s*CM"
FAN_WORD = r"風扇|反向扇|反葉扇|\bFAN\b"
LIQUID = r"水冷|一體式|\bAIO\b|下吹式|導管|塔散"
CASE_WORD = "機殼|透側|玻璃側|全景玻璃|網狀版|透側版"

RULES: dict[str, list] = {
    # What a title looks like.
    "laptop_like": [r"\d{1,2}(?:\.\d)?\s*吋|筆電|筆記型|LAPTOP|電競筆|手提電腦"],
    "looks_case": [
        ("!@not_case", "機殼|機箱"), ("!@not_case", r"顯卡長|CPU高|U高|塔散\s*\d|全景玻璃|玻璃透側|玻璃側板|鷗翼式|側透玻璃"),
        ("!@not_case", r"\b(?:E-?ATX|M-?ATX|MINI-?ITX|ITX|ATX)\b", "顯卡支撐|內建風扇|支援背插主板|可調顯卡支撐|玻璃透側|全景"),
    ],
    "looks_motherboard": [(CHIPSET, r"相\s*(電源|供電)|供電|\bDIMM\b|\bM-?ATX\b|MATX|MICRO-ATX|Mini-ITX|\bE?-?ATX\b|\bEEB\b|LGA\d|\bAM[45]\b|晶片組|主機板|\bLAN\b", "!@not_motherboard")],
    "looks_psu": [
        ("!@not_psu", "!@built_in_psu", r"\b\d{3,4}\s?W\b", r"\b(8\d|9[0-2])\s*[+＋]|金牌|銅牌|白金牌|鈦金|銀牌|白牌|PLATINUM|GOLD|BRONZE|TITANIUM|全模組|半模組|直出|ATX\s*3\.|\bSFX\b|12VHPWR"),
        ("!@not_psu", "!@built_in_psu", "金牌|銅牌|白金|鈦金|銀牌|白牌|PLATINUM|GOLD|BRONZE|TITANIUM", r"全模組|半模組|直出|ATX\s*3\.|12VHPWR"),
    ],
    "looks_ssd": [(r"讀\s*[:取]?\s*\d{3,5}|寫\s*\d{3,5}|\bTLC\b|\bQLC\b", r"M\.2|2\.5吋|Gen\d\s*PCIe|PCIe\s*[345]\.0|NVMe", r"!7200|5400|5640|\d+轉|那嘶狼|紅標|金標|藍標|EXOS|監控")],
    "looks_hdd": [("!@not_hdd", r"(7200|5400|5640|5900)\s*轉|IRONWOLF|那嘶狼|紅標|EXOS|BARRACUDA|SKYHAWK|WD\s*(RED|PURPLE|GOLD)|外接硬碟|行動硬碟|MY\s*BOOK|EXPANSION\s*DESKTOP|新黑鑽|雙硬碟儲存")],
    "looks_fan": [
        (f"!{LIQUID}|散熱器", f"!{GPU_NAME}", "!@looks_psu", FAN_WORD, r"\bRPM\b|\d{3,4}\s*轉|軸承|反向扇|反葉扇"),
        (f"!{LIQUID}|散熱器", f"!{GPU_NAME}", "!@looks_psu", FAN_SIZE, r"\bPWM\b|[34]\s*PIN", r"\bRPM\b|\d{3,4}\s*轉|軸承|反向扇|反葉扇"),
    ],
    "looks_cable": [
        ("!@not_cable", r"\d+(?:\.\d+)?\s*(?:米|M\b|CM\b|公分)", r"公\s*(?:-|對)\s*[公母]|母\s*(?:-|對)\s*[公母]"),
        ("!@not_cable", r"\d+(?:\.\d+)?\s*(?:米|M\b|CM\b|公分)", r"\b(?:HDMI|DP|DVI|VGA|USB|Type-?[AC]|SATA|IDE|RJ-?45|D-?SUB)\b[^,+＋]{0,14}\bto\b|\bCAT\.?\s?[5-8][A-Z]?\b"),
    ],
    "built_in_psu": [r"內[附含][^\/,、]{0,8}(\d{2,4}\s?W\b|電源|PSU)"],
    # What a title is not, although its words say so.
    "not_cpu": [
        "@laptop_like", "@looks_motherboard", "@looks_case", (r"發光線|STRIMER|燈效線|2\s*[×xX]\s*8-?PIN", r"!處理器|PROCESSOR|CORE\s*I|RYZEN|XEON"),
        "筆電|筆記型|LAPTOP|掌機|CLAW|ALLY|DECK|Z1|Z2|RYZEN Z|NUC|MINI PC|迷你電腦|準系統|工作站|套裝電腦|AIO PC|保護蓋|扣具|防彎|散熱器|水冷|防彎扣具|防壓框|螺絲|轉接卡|保護套|主機板|主板|LIQUID|冷頭|冷排|導熱貼|導熱膏|散熱膏|相變",
    ],
    "not_motherboard": [
        r"延長線|【PCI-?E[^】]*】|PCI-?E.{0,16}(?:USB\s*\d+G|TYPE-?C)|\bGALILEO\d*\b|\bEDISON\b.{0,20}\bARDUINO\b", "@looks_case",
        # "PCI-E to", "E-key" and "M.2 to" are no words of this list: titles are searched in upper case, where these never occur.
        r"轉接|擴充|托盤|支架|相容|僅支援|燈效|套件|組合|大全配|螺絲|天線|擋板",
    ],
    "not_gpu": [
        "@laptop_like", r"ALLY|CLAW|DECK|RYZEN\s*Z[12]|播放器|電視盒|SHIELD\s*TV", (r"商用工作站|商用主機|準系統|迷你主機|套裝主機|套裝電腦|桌上型主機|MINI\s*PC", "!繪圖卡|顯示卡"), "@looks_fan", "@looks_psu",
        "顯卡長|CPU高|U高|硬碟位|玻璃透側|全景玻璃|支援背插|防塵網|機箱|手提包",
        "支撐架|千斤頂|直立式|延長線|鍍金線|套件|掌機|筆電|內顯|機殼|長度限高|電源倉|水冷頭|水冷板|顯卡線|轉接頭|支架|排線|轉接線|顯卡排線|橋接器|SLI橋接",
    ],
    "not_ram": [r"顯示卡|VRAM|SSD|M\.2|GDDR|顯存|套裝主機|電供|散熱片|外殼|散熱膏"],
    "not_ssd": [
        (r"USB\s*10G|雙模", r"!\d+(?:\.\d+)?\s*TB", r"!usb\b\d{3,4}\s*G+B?\b"), ("散熱片|散熱貼|導熱", r"!讀\s*[:取]?\s*\d{3,5}|寫\s*\d{3,5}|\bTLC\b|\bQLC\b"),
        r"筆電|工作站|工作主機|外接盒|主機板|準系統|外接座|轉接卡|轉接線|螺絲|外接硬碟|行動硬碟|硬碟儲存|MY BOOK|EXPANSION DESKTOP|新黑鑽|雙硬碟|3\.5吋外接",
    ],
    "not_hdd": ["外接盒|轉接|托架|排線|連接器|防震包|收納|SSD|固態硬碟|防震盒|耳機|耳麥|RAZER|雷蛇|HDMI|傳輸線|風扇|鍵盤|滑鼠|PWM|ARGB|入組|3PIN|燈效"],
    "not_cooler": [
        ("導熱貼|相變導熱|扣具|防彎", r"!散熱器|水冷|\bAIO\b|塔散|冷排|冷頭"), ("套裝PC|顯示卡|主機板", r"!散熱器|水冷|\bAIO\b|塔散|冷排|冷頭"),
        ("@looks_case", r"!水冷|一體式|\bAIO\b|冷頭|冷排|塔散|下吹式|導管|散熱器"), r"NotePal|散熱墊|筆電散熱|筆電支架|網通設備\s*散熱架|鋁合金.{0,12}筆電",
    ],
    "not_psu": ["延長線|分接|電源線|排插|測試器|轉接|不斷電|UPS|保護蓋|行動電源|快充|充電|磁吸|MAH|GAN|音響|喇叭|藍牙|藍芽|擴充線|轉換|外接盒|抽換|硬碟外接|獨立電源開關|BAY"],
    "not_speaker": [("含喇叭|內建喇叭", r"HDR|HDMI|2H1C|\bVA\b|\bIPS\b|SMART\s*M\d|S\d{2}[A-Z]"), r"螢幕|顯示器|MONITOR|電競螢幕|\bFHD\b|\bQHD\b|\bUHD\b|4K|2K|1080P|1440P"],
    "not_os": [r"燒錄機|燒錄器|光碟機|BLU-?RAY|藍光", r"鏡頭|WEBCAM|不斷電|\bUPS\b|硬碟|\bSSD\b|畫素|對焦|備份軟體|監控軟體"],
    "not_cable": [
        (r"!(?:主機板|主板).{0,20}(?:24\s*PIN|ARGB).{0,20}延長線", r"立架|豎立|直立套件|支撐架|顯卡套件|集線器|\bHUB\b|外接盒|硬碟座|讀卡機|機殼|主機板|【\d{2}型】|電競螢幕|液晶螢幕"),
        (r"!(?:主機板|主板).{0,20}(?:24\s*PIN|ARGB).{0,20}延長線", r"80\s?\+|金牌|白金|銅牌|鈦金", r"全模組|半模組|ATX\s?3"),
    ],
    "case_body": [r"顯卡長|CPU高|U高|塔散\s*\d|全景玻璃|玻璃透側|側透玻璃|鷗翼|內建風扇|玻璃側板|工業機殼|電腦機殼|網狀版|透側版|全景玻璃機殼|玻璃透側機殼", r"\b(?:E-?ATX|M-?ATX|MINI-?ITX|ITX|ATX)\b"],
    "not_case": [
        r"TRAVEL\s*CASE|ALLY|掌機|收納|保護包|保護套|防潑水|攜行包|包$",
        (r"水冷頭|冷排|預裝風扇|一體式水冷|\bAIO\b|RYUO|龍王|龍神|WATERFORCE|鷹魂|飛鷹", r"水冷|冷頭|冷排|\bAIO\b|散熱器|\d{3}\s*mm", "!顯卡長|CPU高|U高|玻璃透側|全景玻璃|工業機殼|網狀版|透側版"),
        (r"支撐架|直立套件|燈條套件|燈效套件|磁吸燈條|垂直顯卡支架|顯卡支架|擴充\s*USB\s*模組|USB\s*模組|USB\s*HUB|\bHUB\b|機殼專用", "!@case_body"), "^^↪",
    ],
    "furniture": ["電競椅|電競桌|升降桌|電腦桌|辦公椅|工學椅|沙發|椅墊|腳托|桌墊超值組"],
    "not_fan": [
        "不含風扇|不附風扇|無風扇", LIQUID, GPU_NAME, "@looks_psu", "集線器|延長線|串接線|排線|擴充線|燈條|燈效套件|支撐架|千斤頂|散熱膏|轉接",
        (r"控制器|無線控制器|燈光控制器|\bHUB\b|擴充USB|擴充模組|連接線|同步線|1轉3|訊號線|風扇專規接頭", "!@fan_body"), ("螢幕|LCD液晶", r"!風扇|\bFAN\b"), "^^↪",
    ],
    "fan_body": [(FAN_WORD, FAN_SIZE)],
    "not_network": [
        "^^↪", (r"軌跡球|TRACKBALL|滑鼠|遊戲鼠|鍵鼠|鍵盤(?:[^托]|$)", "!路由器|網卡|交換器|NAS|MESH|分享器"),
        (r"智慧紅外線|IoT\s*網關|紅外線.*閘道|閘道.*紅外線", r"!路由|交換|網卡|MESH|分享器|NAS|EAP|Wi-?Fi\s*[56]"),
        r"印表機|複合機|事務機|連續供墨|充電座|充電盤|充電器|行動電源|耳機|耳麥|掌機|ALLY|CLAW\s*A\d|HDMI|傳輸線|喇叭|聲霸|SOUNDBAR|擴音機|工作站|網路線|\bCAT\.?\s?[5-8]|SCREENBAR|螢幕.{0,4}掛燈",
    ],
    "not_monitor": [
        r"水冷|AIO|水冷頭|RYUJIN|龍神|GAMING\s*LC", "可觸控|觸控顯示|鍵盤|滑鼠", r"電源供應|POWER\s*SUPPLY|OLED\s*顯示|THOR", "投影機|升降桌|電腦桌|電競桌|工作桌",
        r"SCREENBAR|螢幕.{0,4}掛燈|非對稱照明|ERGO\s*ARM|洞洞板|收納架|滿\s*[\d,]+.*贈", r"AA級均勻照明|超廣燈體|滿[^：:]{0,15}[：:]?\s*贈|顏色可混.{0,8}活動|LCD磁吸數位螢幕",
        (r"Trofeo\s*Vision\s*LCD", r"!(?:^|\D)(240|280|360|420)(?:\D|$)"), ("磁吸", "數位顯示|數位螢幕|LCD", r"6\.\d+\s*吋|1280\s*[x×*]\s*480|USB\s*(?:介面|9-?Pin)"),
        r"\bSST-?ARM|螢幕臂|氣壓彈簧|氣壓式|穿夾兩用|單螢幕\s*[\/／]|雙螢幕\s*[\/／]|最大支援\s*\d+\s*吋", (r"RAYMII|HALO-?MAX", "承載|氣壓|穿夾|單螢幕|雙螢幕"),
        r"筆電架|筆電支架|增高支架|折疊支架|鋁合金.*支架|支架.*筆電|通用於\s*\d+.*筆電|適用\d+(?:\.\d)?吋以下筆電",
        (r"筆電|筆記型|LAPTOP|OMNIBOOK|THINKPAD|ZENBOOK|VIVOBOOK|IDEAPAD|YOGA\s*\d|PAVILION|ENVY\s*\d|ZBOOK|INSPIRON|LATITUDE", f"{STORAGE}|{CPU_NAME}|" + r"\b\d{1,2}G\b.*(?:SSD|HDD|硬碟)|LPDDR"),
        r"\b\d(?:\.\d)?\s*吋.{0,20}(?:LCD|萬用螢幕|擴充螢幕)|(?:LCD|萬用螢幕|擴充螢幕).{0,20}\b\d(?:\.\d)?\s*吋", ("直播控制器|NEXUS", r"觸控|旋鈕|直播|AX\d"),
        ("鍵盤|鍵軸|光鍵|三模|收割者軸", "(?:吋|LCD|LED).{0,12}(?:螢幕|彩屏)|(?:螢幕|彩屏).{0,12}(?:吋|LCD)"), "^^↪", ("螢幕訊號線|訊號線|公對公|公對母", r"\b(?:VGA|HDMI|DP|DVI)\b"), "@looks_cable",
        "螢幕架|螢幕支架|螢幕掛燈|增高架|壁掛架|機殼",
    ],
    # Parts of the bundle rules.
    "cable_accessory": ["編織線|延長線|理線|線材|轉接線|線規"],
    "nas": [(r"\d+\s*Bay", r"NAS|SYNOLOGY|群暉|QNAP|威聯通|華芸|ASUSTOR|\bDS\d{3}|\bTS-?\d{3}")],
    "psu_model": [r"(?:^|\D)(?:450|[5-9][05]0|1\d[05]0|2000)(?:GM|GS|GX|GH|PT|P|W)\b", r"\b(?:GX|GM|GS|GH|PX)[-\s]?(?:450|[5-9][05]0|1\d[05]0|2000)\b"],
}

#: (reason, clauses) of complete systems and bundles, in the order in which they are tried; EXEMPT titles have none.
EXEMPT = ["【加購優惠】|^加購優惠", "@nas"]
BUNDLES: tuple[tuple[str, list], ...] = (
    ("server-workstation", [(r"伺服器|工作站|\bSERVER\b", "!@laptop_like", "!主機板|機殼|電源供應器|記憶體|散熱器|網路卡|顯示卡|繪圖卡|鍵盤|滑鼠|螢幕", r"\/.*\/", r"\b\d{2,3}\s*G\b|DDR[45]|\bD[45]\b", STORAGE + r"|\d{3,4}\s?W\b")]),
    ("laptop", [("筆電|筆記型|LAPTOP|電競筆", r"\d{1,2}(?:\.\d)?\s*吋", STORAGE)]),
    ("handheld", [(r"掌機|ROG\s*(?:XBOX\s*)?ALLY|CLAW\s*A\d|STEAM\s*DECK|LEGION\s*GO", STORAGE)]),
    ("barebone", [(r"準系統|迷你主機|迷你電腦|MINI\s*PC(?:[^I]|I[^E]|I?$)|\bNUC\b|\bCUBI\b|\bBRIX\b|DeskMini|DeskMeet", "!模組|機殼")]),
    ("retail-system", ["品牌電腦|品牌機|套裝電腦|套裝主機|桌上型主機|桌上型電腦|電競電腦|欣亞PC|整機電腦|整機主機"]),
    ("prebuilt-os", [(CPU_NAME, r"WIN(DOWS)?\s*1[01]|\bW1[01]\b|NON-?OS", STORAGE)]),
    ("ai-workstation", [(r"ASUS\s+ASCENT\s+GX10|DGX\s*SPARK|GB10|AI\s*TOP\s*ATOM|BRAINS?PHERE", r"\/.*\/|SSD|GEN4|1\s?TB|\b128G\b")]),
    ("complete-spec", [(r"\/.*\/", CPU_NAME, GPU_NAME, r"\b\d{2,3}\s*G\b|DDR[45]", STORAGE), (r"\/.*\/", CPU_NAME, CHIPSET, r"\b\d{2,3}\s*G\b|DDR[45]", STORAGE)]),
    ("select-build", [(r"CPU\.RAM\.DISK選購|PRO\s*DP21", CHIPSET)]),
    ("branded-desktop", [(r"Infinite\s*S\d|Infinite\s*Z\d|AORUS\s*PRIME|商用工作站|Z2G?\d", CPU_NAME, "WIN|NON-?OS", STORAGE)]),
    ("ai-top", [(r"【AI\s*TOP[^】]+】", GPU_NAME, r"\/.*\/")]),
    ("slash-build", [(CPU_NAME, r"電供|電源|\d{3,4}\s?W\s*電|\d{3,4}\s?W\b.*(金牌|銅牌|白金)", r"機殼|水冷|空冷|散熱|\b[125]\s?T\b|\b\d{3}G\b|\b\d{2,3}G\s*\/|SSD|RTX\s?\d{4}|\bRX\s?\d{4}\b|" + CHIPSET)]),
    ("bundle-keyword", [("大全配|全配|超值組|組合包|套餐|欣巴組|捷元品牌電腦|合購|限量組合|優惠組合|組合優惠|螢幕支架組", "!@cable_accessory")]),
    ("plus-part", [("@plus_brand", r"~[+＋][^+＋]{0,45}(電源|電供|POWER\b|主機板|記憶體|RAM\b|DDR[45]|SSD|硬碟|固態|螢幕|MONITOR|OFFICE|WIN1|顯卡|顯示卡|繪圖卡|機殼|鍵盤|滑鼠|喇叭|耳機|電競桌)")]),
    ("plus-monitor-peripheral", [r"~(螢幕|顯示器|MONITOR).{0,90}[+＋]\)?[^+＋]{0,90}(鍵盤|滑鼠|狼蛛|AULA|電競桌)"]),
    ("plus-gpu", [r"~(?:^|[^A-Z0-9])[+＋]\s*[^+＋]{0,60}(?:\b(?:RTX|GTX)\s?\d{3,4}\b|\bRX\s?\d{3,4}\b|\bArc\s?[AB]\d{3}\b)"]),
    ("plus-cpu-chipset", [(CPU_NAME, r"~[+＋]\s*[^+＋]{0,80}\b(?:Z890|W890|Z790|W790|B860|B760|H810|H610|W680|X870E|X870|WRX90|TRX50|B850|B840|X670E|X670|B650E|B650|A620|B550|A520)[A-Z-]*\b")]),
    ("plus-psu-rated", [("!@built_in_psu", r"~[+＋][^+＋]{0,30}\d{3,4}\s?W\b[^+＋]{0,12}(金牌|銅牌|白金|鈦金|銀牌|白牌)")]),
    ("case-plus-psu", [("!@built_in_psu", "=[+＋]", "=" + CASE_WORD, r"=電源|電供|\d{3,4}\s?W\b"), ("!@built_in_psu", "=[+＋]", "=" + CASE_WORD, "@psu_model")]),
    ("case-plus-cooler", [("!@built_in_psu", "=[+＋]", "=" + CASE_WORD, r"=散熱器|水冷|\bAIO\b|冷排|冷頭|塔散|\bLC\s*\d{3}\b|\bNX\d{3}\b|WATERFORCE|龍王|RYUO|飛鷹|鷹魂")]),
)

#: Plus signs that join nothing: (pattern, replacement), in order.  Chains of numbers take two passes.
FALSE_PLUS = (
    (r"\d[\d+＋\s]*(相\s*(電源|供電)|電源相位)", " 相供電 "), (r"顯[示]?卡\s*(長|支援|支撐架?|\d{2,3}\s*(mm|cm|公分))", " "), (r"塔散\s*\d{2,3}", " "),
    (r"\b(8\d|9[0-2])\s*[+＋]", "$1 "), (r"(\d+)\s*G\b\s*[+＋]\s*(\d+)\s*G\b", "$1G $2G"), (r"(\d\s*)[+＋](\s*\d)", "$1 $2"), (r"(\d\s*)[+＋](\s*\d)", "$1 $2"),
)
BUILT_IN = r"[（(]內[附含][^）)]*[）)]"
#: What follows a plus sign, after a remark in brackets.
PLUS = r"[+＋]\s*(?:【[^】]*】\s*)?([^+＋]{2,28})"

#: (category, clauses) of what titles show without naming it, in order.
IMPLICIT: tuple[tuple[str, list], ...] = (
    ("case", [("!@not_case", "顯卡長|顯卡支援", "CPU高|U高|玻璃|透側")]), ("hdd", ["@looks_hdd"]), ("fan", ["@looks_fan", ("!@not_fan", r"[34]\s*PIN", r"\bRPM\b")]), ("gpu", [(GPU_NAME, "!@not_gpu")]),
    ("motherboard", ["@looks_motherboard"]), ("psu", ["@looks_psu"]), ("ssd", [("@looks_ssd", "!@not_ssd")]),
    ("monitor", [("!@not_monitor", "@not_speaker", r"含喇叭|內建喇叭|SMART\s*M\d|S\d{2}[A-Z]")]), ("cable", ["@looks_cable"]),
)
#: (category, words) in the order in which they are tried.
KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("package", ("組合", "欣巴組", "優惠組", "捷元品牌電腦", "欣亞PC", "電競電腦", "限量組合", "套餐", "超值組", "超值搭配", "組合包", "大全配", "合購")),
    ("keyboard", ("鍵盤", "鍵鼠組", "Keyboard")), ("mouse", ("滑鼠", "Mouse")), ("headset", ("耳機", "耳麥", "Headset", "Headphone")), ("speaker", ("喇叭", "Speaker")), ("case", ("機殼", "Case", "Chassis")),
    ("cooler", ("散熱器", "CPU散熱", "Cooler", "AIO", "水冷", "空冷", "塔散", "下吹式", "導管", "一體式", "Liquid", "冷排", "冷頭")), ("motherboard", ("主機板", "主板", "Motherboard")),
    ("gpu", ("顯示卡", "顯卡", "繪圖卡", "Graphics", "GeForce", "Radeon")), ("ram", ("記憶體", "Memory", "DDR")), ("ssd", ("固態硬碟", "SSD", "NVMe", "M.2")), ("hdd", ("傳統硬碟", "硬碟", "HDD", "Hard Drive")),
    ("psu", ("電源供應器", "電源", "Power Supply", "PSU")), ("fan", ("風扇", "Fan", "PWM")),
    ("cable", ("線材", "傳輸線", "轉接線", "延長線", "充電線", "網路線", "排線", "電源線", "音源線", "光纖線", "編織線", "轉接頭", "轉接器", "切換器", "分配器", "Cable")),
    ("network", ("網路", "無線", "Router", "Wi-Fi", "NAS")), ("os", ("作業系統", "Windows", "軟體", "Software", "防毒", "Office", "Microsoft 365")), ("monitor", ("螢幕", "顯示器", "Monitor", "電競螢幕")),
    ("cpu", ("處理器", "CPU", "Processor", "Core i3", "Core i5", "Core i7", "Core i9", "Core Ultra", "Ryzen")),
)
#: What a category must not be, by keyword and as a category given by a source.
GUARDS = {
    **{c: f"not_{c}" for c in ("cpu", "motherboard", "gpu", "ram", "ssd", "hdd", "cooler", "psu", "case", "speaker", "os", "cable", "monitor", "fan", "network")},
}
FURNITURE_IN = ("keyboard", "mouse", "speaker", "cooler")
#: Categories that a source's word is taken for whatever is found (cables), and what else makes it doubtful.
UNDOUBTED = ("cable",)
DOUBTS = {"network": ["@looks_motherboard"], "cpu": ["@looks_motherboard", "@looks_case"], "motherboard": ["@looks_case"]}
RETAINED = R.RETAINED
