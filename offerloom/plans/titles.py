"""Shop titles of our own making: two lists of phrases that parts combine, so that every rule meets some title."""

from __future__ import annotations

HEADS = (
    "MSI RTX 5070 VENTUS 2X 12G", "華碩 TUF RX9070XT 16G OC", "技嘉 Arc B580 WINDFORCE 顯示卡", "RTX 5060 顯卡支撐架", "GeForce GT 1030 2G 靜音卡", "RTX4060 電競筆電 15.6吋 512G SSD", "商用工作站 繪圖卡 RTX 4000",
    "ASRock B650M 主機板 AM5 DDR5", "Z890 AORUS 20+1+2相供電 LGA1851", "B760M 支援DDR5 M-ATX 2.5G LAN", "主機板 24Pin ARGB 延長線 30cm", "PCI-E TO USB 擴充卡 主機板用", "Intel Core i5-14400 處理器 盒裝", "AMD Ryzen 7 9800X3D 不含風扇",
    "CPU 散熱膏 4g", "CPU 防彎扣具 LGA1700", "Core i7 迷你電腦 準系統", "Xeon W5-3423 工作站 主機/64G/1T SSD/RTX 4000", "HP 筆記型電腦 14吋 i5-1335U 16G 512G", "ROG ALLY 掌機 512G", "MINI PC N100 8G 256G SSD", "DeskMini B760 準系統", "DeskMini 專用 WiFi 模組",
    "捷元 品牌電腦 i3 商用", "i5-14400 / B760 / 16G DDR5 / 1T SSD / 500W 電源 / 機殼", "R5-7600 / RTX 4060 / 16G / 512G SSD / WIN11", "ASUS ASCENT GX10 / 128G / 1TB", "【AI TOP 100】RTX 5090 / Z890 / 64G", "Infinite S3 i7-14700 RTX 4060 WIN11 1T", "PRO DP21 H610 CPU.RAM.DISK選購",
    "華碩 TUF 27吋 電競螢幕 + 羅技 G102 滑鼠", "AOC 24型 螢幕 + AULA 鍵盤", "聯力 機殼 玻璃透側 + 海韻 750W 金牌", "darkFlash 機殼 全景玻璃 + 曜越 水冷 360", "喬思伯 機殼 網狀版 + Focus GX-850", "ITX 電腦機殼 (內含 SFX 850W) 白", "Ryzen 5 7600 + B650M PLUS 合購", "微星 B760 主機板 + 金士頓 DDR5 記憶體 16G",
    "群暉 DS225+ NAS 2Bay", "威聯通 TS-464 4 Bay NAS", "【加購優惠】滑鼠墊", "螢幕支架組 雙臂", "編織線 組合包 黑", "海韻 FOCUS 850W 80+金牌 全模組", "全漢 UD750GM 金牌 全模組 ATX 3.1", "電源線 1.8米", "行動電源 20000mAh 快充 65W", "不斷電系統 UPS 500VA 監控軟體",
    "美光 T700 1TB Gen5 PCIe M.2 讀14500 TLC", "固態硬碟 480G SATA 2.5吋", "M.2 SSD 外接盒 USB 10G 雙模", "M.2 SSD 480G USB 10G", "M.2 SSD 散熱片", "SSD 1TB 含散熱片 讀:7000 寫:6000", "SSD 轉接卡", "那嘶狼 8TB 7200轉", "WD RED 4TB NAS 硬碟", "東芝 外接硬碟 2TB", "3.5吋 硬碟 外接盒", "Razer Barracuda 耳機 BARRACUDA",
    "Noctua 風扇 120 PWM 1500 RPM", "反向扇 14CM 3PIN 1200轉", "風扇 集線器 PWM", "風扇控制器 HUB", "120mm ARGB 風扇 控制器 HUB", "一體式水冷 360 冷排", "塔散 雙塔 CPU散熱器 高 155mm", "筆電散熱墊 Cooler", "相變導熱貼 散熱", "導熱貼 顯示卡 Cooler 用",
    "機殼 ATX 顯卡長 400mm CPU高 165mm", "玻璃透側 顯卡長 360 塔散 160", "直立套件 機殼專用", "掌機 收納包 TRAVEL CASE", "E-ATX 顯卡支撐 內建風扇", "↪ 加購 機殼 風扇 網路", "顯卡支援 420mm 玻璃 ITX",
    "LG 27吋 螢幕 IPS 180Hz", "SMART M7 智慧 32型 含喇叭", "螢幕掛燈 SCREENBAR", "氣壓式 螢幕臂 雙螢幕/承載8KG", "OLED 顯示 THOR 電源", "7吋 LCD 擴充螢幕", "Trofeo Vision LCD 顯示器", "磁吸 數位螢幕 6.8 吋", "直播控制器 觸控 螢幕", "機械鍵盤 1.14吋 彩屏 三模", "ThinkPad 螢幕 14吋 512G", "投影機 顯示器",
    "羅技 無線滑鼠 M185", "鍵鼠組 有線", "電競椅 鍵盤托", "升降桌 滑鼠 喇叭", "耳麥 無線 7.1", "2.1 喇叭 藍牙", "喇叭 4K 顯示器", "HDMI 2.1 公-公 2米", "USB to RJ45 1.5M 轉接器", "CAT.6A 網路線 3米", "Type-C HUB 集線器 線材", "【27型】線材 KVM 切換器", "排線 金牌 全模組",
    "TP-Link 路由器 Wi-Fi 7", "無線網卡 PCIe", "軌跡球 無線", "智慧紅外線 IoT 網關 無線", "印表機 無線 Wi-Fi", "無線 鍵盤托 路由器", "Windows 11 Home 隨機版 含DVD", "防毒軟體 3年", "藍光 燒錄機 軟體", "網路攝影機 WEBCAM 軟體", "DDR5 6000 16G*2 記憶體", "記憶體 散熱片", "DDR5 VRAM", "光纖線 Cable", "什麼都不是的東西",
)
TAILS = (
    "", "", "", "限組裝", "組裝價", "搭板價", "搭購優惠", "加購價", "白色", "黑色版", "+ 威剛 DDR5 16G", "+ 美光 1TB SSD", "+RTX 5060", "+ 650W 銅牌 電供", "＋機殼", "8G+8G", "18+3+3 電源相位", "85+ 認證", "內附 200W 電源", "支架", "延長線", "WIN11", "/ 32G / 1T SSD", "水冷", "NON-OS", "低藍光+不閃屏", "Z790 + 14700K", "大全配",
)

#: Titles of coolers, cases, peripherals, network gear, cables, software and bundles.
GEAR = (
    "華碩 TUF GAMING LC 360 ARGB", "酷碼 MasterLiquid 240L 水冷 RGB", "EK 水冷液 紅 1L", "SSD 散熱片 2280 鋁", "Arctic 散熱膏 4g", "雙塔 六導管 CPU散熱器 高15.7", "單塔 塔散 高度：165mm", "下吹式 薄型 高 4.7cm", "利民 AX120 空冷 高 14 cm", "液態金屬 1g 導熱", "TH-240 冷排 白", "CPU 水冷頭 (透明)", "飛龍 360 冷頭",
    "聯力 O11 DYNAMIC E-ATX", "華碩 AP201 網狀版", "4U 工業機殼 RM42", "NZXT H5 Flow ATX 黑", "喬思伯 N3 Mini-ITX", "MSI MAG FORGE M-ATX", "Fractal Design North XL", "be quiet! Pure Base 500 ATX", "Montech AIR 903",
    "i-Rocks K71R 機械 紅軸 三模", "羅技 K120 薄膜 USB", "AULA F75 熱插拔 收割者軸", "羅技 G304 LIGHTSPEED 電競", "垂直 滑鼠 有線", "M185 2.4G 滑鼠", "HyperX QuadCast USB 麥克風", "電容 麥克風 XLR", "無線 麥克風 領夾", "Sony 藍牙 耳機", "耳麥 7.1 電競",
    "Creative 聲霸 2.1", "Edifier R1280 2.0 藍牙", "超低音 喇叭 SW8", "三件式 2.1 喇叭", "JBL 便攜 喇叭", "四聲道 喇叭", "聯力 TL120 風扇", "NF-A14 14CM", "NF-A9 92mm", "TP-Link ARCHER AX55", "Archer TX55E PCIe", "DECO X50 三入", "8埠 TL-SG108", "RE315 AX1500 延伸", "EAP610 吸頂", "群暉 DS225+", "羅技 C920 WEBCAM",
    "KVM 2進1出 切換器", "HDMI 一進二出 分配器", "CAT.6A 扁線 3米", "CAT8 網路線", "24Pin ARGB 延長線", "12V-2X6 電源線", "SATA3 排線", "6座 延長線 防雷", "HDMI 轉接器 TYPE-C", "RJ45 USB 轉接線", "DP 1.4 線 2米", "光纖 音源線", "Type-C to C 240W", "USB-A to Type-C", "TB4 線 1米", "Lightning 充電線",
    "Office 2024 家用版 WIN10", "Windows 11 Pro 彩盒", "Windows 10 Home", "PC-cillin 防毒 3年", "Windows Server 2025", "Linux 套件", "聯力 機殼 + 海韻 750W", "水冷 360 + 金牌 850W", "機殼 玻璃側 + 塔散", "R5-7600 + B650M", "B760 + DDR5 16G", "螢幕 + 滑鼠", "鍵鼠組 耳機", "RTX 5070 搭購", "什麼都沒有",
)
GEAR_TAILS = ("", "白色", "RGB", "+ 風扇", "ASUS", "無線", "2入", "USB", "360", "ITX", "電源")


def _pick(values: tuple[str, ...], number: str) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: p_partkey and title; every head meets every tail as the number of parts grows, and each stands alone for every seventh part.
TITLES_SQL = f"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN {_pick(HEADS, 'CAST(floor(p_partkey / 7) AS BIGINT)')} ELSE concat({_pick(HEADS, 'p_partkey')}, ' ', {_pick(TAILS, 'CAST(floor(p_partkey / 3) AS BIGINT)')}) END AS title FROM part"""
GEAR_SQL = f"SELECT p_partkey, concat({_pick(GEAR, 'p_partkey')}, ' ', {_pick(GEAR_TAILS, 'CAST(floor(p_partkey / 2) AS BIGINT)')}) AS title FROM part"
#: (category, path) of our own choice, those of a category in the order in which they are shown.  The first chip
#: number of a path counts, so below "RX 9000系列" models follow by name.
NODES = (
    ("cpu", "Intel"), ("cpu", "AMD"), ("cpu", "Intel > Core Ultra 200S > Ultra 9"), ("cpu", "Intel > 第 14 代 > Core i9"), ("cpu", "Intel > 第 12 代 > Core i5"), ("cpu", "AMD > Ryzen 9000 (Zen5) > Ryzen 7"), ("cpu", "AMD > Ryzen 5000 (Zen3)"), ("cpu", "Threadripper 9000"), ("cpu", "Threadripper"), ("cpu", "Core i9"), ("cpu", "Ryzen 5"), ("cpu", "x"),
    ("motherboard", "Intel LGA1851 > Z890 > ASUS"), ("motherboard", "Intel LGA1851 > Z890 > MSI"), ("motherboard", "Intel LGA1851 > B860 > ASUS"), ("motherboard", "Intel LGA1851"), ("motherboard", "AMD AM5 > X870E > ASRock"), ("motherboard", "AMD AM4"), ("motherboard", "MSI"), ("motherboard", "nobody"),
    ("gpu", "NVIDIA RTX 50系列 > RTX 5080"), ("gpu", "NVIDIA RTX 50系列 > RTX 5070 Ti"), ("gpu", "NVIDIA RTX 50系列 > RTX 5070"), ("gpu", "NVIDIA RTX 40系列"), ("gpu", "AMD RX 9000系列 > RX 9070 GRE"), ("gpu", "AMD RX 9000系列 > RX 9070 XT"), ("gpu", "MSI"), ("gpu", "RX 9070 XT"), ("gpu", "RX 9070 GRE"), ("gpu", "RTX 5090"), ("gpu", "other"),
    ("ram", "桌上型 UDIMM > DDR5 > 64G (32G*2)"), ("ram", "桌上型 UDIMM > DDR5 > 32G (16G*2)"), ("ram", "桌上型 UDIMM > DDR5 > 32G"), ("ram", "桌上型 UDIMM > DDR4 > 32G"), ("ram", "筆電用 SO-DIMM > DDR5 > 16G"), ("ram", "DDR5"),
    ("ssd", "M.2 NVMe SSD > PCIe 5.0 > 2TB"), ("ssd", "M.2 NVMe SSD > PCIe 5.0 > 500GB"), ("ssd", "M.2 NVMe SSD > PCIe 4.0 > 4TB"), ("ssd", "SATA 2.5吋 > 1TB"), ("ssd", "4TB"), ("ssd", "960GB"), ("hdd", "桌上型硬碟 > 3.5 吋 > 8TB"), ("hdd", "桌上型硬碟 > 3.5 吋 > 4TB"), ("hdd", "監控碟 > 3.5 吋 > 18TB"),
    ("case", "Mini-ITX > JONSBO"), ("case", "M-ATX > ASUS"), ("case", "ATX > NZXT"), ("case", "E-ATX > Lian Li"), ("case", "機架式 / 工業"), ("case", "Lian Li"), ("keyboard", "機械式鍵盤 > 靜音紅軸 > 有線"), ("keyboard", "機械式鍵盤 > 紅軸 > 有線"), ("keyboard", "機械式鍵盤 > 紅軸 > 無線"), ("keyboard", "薄膜鍵盤 > 有線"), ("keyboard", "茶軸"), ("keyboard", "無線"),
    ("mouse", "電競滑鼠 > 無線"), ("mouse", "一般滑鼠 > 有線"), ("psu", "ATX 電源 > 1000W 以上 > 80+ 白金牌"), ("psu", "ATX 電源 > 1000W 以上 > 80+ 金牌"), ("psu", "SFX 電源 > 600W~750W"), ("cooler", "一體式水冷 (AIO) > 360mm > ARGB"), ("cooler", "一體式水冷 (AIO) > 240mm > 無光"), ("cooler", "單塔空冷 > 151–160mm > 無光"), ("cooler", "散熱膏/配件"),
    ("monitor", "可攜 / 小尺寸 > 16吋 > Acer"), ("monitor", "27吋 > LG"), ("monitor", "34吋超寬"), ("monitor", "大型顯示器 > 55吋"), ("monitor", "其他尺寸 > 28吋"), ("fan", "12cm 風扇"), ("fan", "其他尺寸風扇"), ("network", "無線路由器 > Mesh 網狀"), ("network", "交換器"), ("network", "其他網通設備"), ("headset", "有線耳機 > Sony"), ("headset", "麥克風"),
    ("speaker", "聲霸"), ("speaker", "便攜藍牙"), ("cable", "網路線 > CAT.8"), ("cable", "網路線 > CAT.6A"), ("cable", "影音線 > HDMI"), ("cable", "切換器 / 分配器 > KVM 切換器"), ("cable", "其他線材"), ("os", "作業系統 > Windows 11"), ("os", "應用軟體 > 防毒軟體"),
    ("package", "整機電腦 > MSI"), ("package", "滑鼠"), ("package", "零件組合 > 機殼 + 電源"), ("package", "零件組合 > 其他組合"), ("package", "搭購價單品 > CPU 處理器 > 組裝價"), ("package", "搭購價單品 > 顯示卡"), ("unknown", "b 9"), ("unknown", "a 2"), ("unknown", "b 2"),
)
NODES_SQL = f"SELECT p_partkey, {_pick(tuple(c for c, _ in NODES), 'p_partkey')} AS category, {_pick(tuple(n for _, n in NODES), 'p_partkey')} AS subcategory FROM part"
