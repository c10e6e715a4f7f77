"""Fixed values.

Patterns, word lists, limits and formats that decide which results come out. They are kept together,
in their natural order and as plain text. Patterns use Java syntax; ``(?U)`` gives Unicode classes,
``(?iu)`` Unicode case folding.
"""

# --- chunk clean-up for model input -------------------------------------------------------------
HTML_COMMENT = r"<!--[^>]*?-->"
PAGE_MARKER = r"(?iuU)^\s*#{1,6}\s*page\s*\d+\s*$"
BREAK_TAG = r"(?i)</?break\s*/?>"
HEADING_NUMBER = r"(?U)^(\s*#{1,6}\s*)\(?\s*\d+\s*\)?(?:\s*[\.)])?\s+"
PLAIN_NUMBER = r"(?U)^\s*\d+\s*[\.)]\s+"
NESTED_IMAGE = r"(?U)!\[\]\(!\[id:\s*([^\]]+?)\]\(([^)]+?)\)\)"
GENERIC_IMAGE = r"!\[[^\]]*\]\([^)]+\)"

# --- book splitters -----------------------------------------------------------------------------
SECTION_TWO = r"(?iuU)^\s*##\s*ii\s*[-–—]\s*"
SECTION_TWO_DRINKS = r"(?iuU)^\s*##\s*ii\s*[-–—]\s*k[ĩiỹy]\s*thuật\s+làm\s+nước\s+giải\s+khát\b"
PART_TWO = r"(?iuU)^\s*#\s*phần\s+hai\b"
PLANT_H2 = r"(?iuU)^\s*##\s*\d+\s*\.\s*(?:CÂY|CAY)\b"
PLANT_H2_TO_H4 = r"(?iuU)^\s*#{2,4}\s*\d+\s*\.\s*(?:CÂY|CAY)\b"
PLANT_BARE = r"(?iuU)^\s*\d+\s*\.\s*(?:CÂY|CAY)\b"
DRINK_HEADING = r"(?iuU)^\s*###\s*\d+\s*\.\s*(?:NƯỚC|NUOC)\b"
OPTION_HEADING = r"(?U)^\s*#{3,6}\s*([a-zA-Z])\)\s*(.+?)\s*$"
ENTRY_NUMBERED = r"(?iuU)^\s*#{2,4}\s*(?:\(?\s*\d+\s*\)?\s*[,\.)]?|\d+\))\s+\S+"
ENTRY_CAPS = r"(?U)^\s*#{2,4}\s*[A-ZÀ-Ỵ][A-ZÀ-Ỵ\s\-]{2,}$"
ENTRY_CAPS_BLOCKED = ("CÁC LOÀI", "MỤC LỤC", "GIỚI THIỆU")
ENTRY_CAPS_MAX_CHARS = 60
ENTRY_ANY_HEADING = r"(?U)^\s*#{2,4}\s+"
ENTRY_TITLE_NUMBER = r"(?U)^\(?\s*\d+\s*\)?\s*[\.)]?\s*"
NUMBERED_SECTION = r"(?U)^\s*(\d{1,3})\s*\.\s+"
IMAGE_LINE = r"(?U)^\s*!\[\]\(|^\s*!\[[^\]]*\]\("
PART_SECOND = r"(?iuU)^\s*#\s*PHẦN\s+THỨ\s+HAI\b"
PART_THIRD = r"(?iuU)^\s*#\s*PHẦN\s+THỨ\s+BA\b"
CHAPTER_HEADING = r"(?U)^\s*#{1,3}\s*(?:\*{1,2}\s*)?(\d{1,3})\s*[\.)]\s+(.+?)\s*$"
PATTERN_HEADING = r"(?iuU)^\s*#{2,6}\s*(?:\*{0,2}\s*)?(?:\(?\s*\d+\s*\)?\s*[\.)])\s*(Thể|Chứng)\b.*$"
EXPERIENCE_HEADING = r"(?iuU)^\s*#{1,6}\s*.*bài\s+thuốc\s+kinh\s+nghiệm.*$"
MONOGRAPH_HEADING = r"(?U)^\s*#{1,4}\s*(?:\*{1,2}\s*)?(\d{1,3})\s*(?:[\.)]\s+|\s+)(.+?)\s*$"
MONOGRAPH_REJECTED = ("BÀI THUỐC", "CÁC BÀI THUỐC")
NUMBER_ONLY = r"(?U)^\s*(\d{1,3})\s*\.\s*$"
NUMBER_AND_TITLE = r"(?U)^\s*(\d{1,3})\s*\.\s+(.+?)\s*$"
LOWER_LETTER = r"[a-zà-ỹ]"
NOT_CAPS_LETTER = r"[^A-ZÀ-Ỵ]"
NOT_CAPS_LETTER_OR_SPACE = r"(?U)[^A-ZÀ-Ỵ\s]"

MIN_CHARS = {
    "plants": 200,
    "recipes": 150,
    "vegetables": 250,
    "chapters": 350,
    "patterns": 220,
    "monographs": 300,
    "protocols": 300,
}

# Path fragment of each book and the splitter used for it, per requested kind.
BOOK_PATHS = (
    ("cay-canh--cay-thuoc", {"recipes": "recipes", "default": "plants"}),
    ("noi-tiet", {"plants": "monographs", "patterns": "patterns", "syndromes": "chapters", "default": "endocrine"}),
    ("cay-rau-lam-thuoc", {"default": "vegetables"}),
    ("cc_va_chong_doc", {"default": "protocols"}),
)
KIND_OF_SCHEMA = {
    "RemedyRecipe": "recipes",
    "MedicinalPlant": "plants",
    "EndocrinePatternRecord": "patterns",
    "EndocrineSyndrome": "syndromes",
    "EndocrineDisease": "syndromes",
}

# --- sentences and overlapping chunks -----------------------------------------------------------
SENTENCE_END = r"(?U)(?<=[\.!?。؛;])\s+"
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
CHUNK_MIN = 100
CHUNK_STOPS = (". ", "! ", "? ", "。", "！", "？")

# --- markdown repair ----------------------------------------------------------------------------
BREAK_MARK = "</break>"
LINE_REPAIRS = (
    (r"(?U)^(#{1,6})([^\s#])", "$1 $2"),
    (r"(?U)^(>+)([^\s>])", "$1 $2"),
    (r"(?U)^(\s*)([-*+])([^\s])", "$1$2 $3"),
    (r"(?U)^(\s*)(\d+)\.([^\s.])", "$1$2. $3"),
)
LINE_REPAIRS_STRICT = (
    (r"(?U)^(#{1,6})([^\s#])", "$1 $2"),
    (r"(?U)^(>+)([^\s>])", "$1 $2"),
    (r"(?U)^(\s*)([-*+])([^\s*+-])", "$1$2 $3"),
    (r"(?U)^(\s*)(\d+)\.([^\s.\d])", "$1$2. $3"),
)
LINK_REPAIRS = (
    (r"(?md)\[([^\]]+)$", "[$1]"),
    (r"(?md)!\[([^\]]+)$", "![$1]"),
    (r"(?md)\(([^\)]+)$", "($1)"),
)
TABLE_SEPARATOR = r"(?U)^\|[\s\-|:]+\|?$"
IMAGE_PLACEHOLDER = r"\[IMAGE_PLACEHOLDER_\d+\]"

# Spans and lines that spelling correction must leave alone, in order of protection:
# (text every such span contains, pattern).
PROTECTED_SPANS = (
    ("$$", r"\$\$[^$]+\$\$"),
    ("$", r"\$[^$\n]+\$"),
    ("<", r"<[^>]+>.*?</[^>]+>|<[^>]+/>|<[^>]+>"),
    ("![id:", r"(?U)!\[id:\s*[^\]]+\]\([^\)]+\)"),
    ("[IMAGE_PLACEHOLDER_", r"\[IMAGE_PLACEHOLDER_\d+\]"),
    ("#", r"(?mdU)^[^\S\n]*#{1,6}[^\S\n]+\S.*$"),
    ("|", r"(?mdU)^[^\S\n]*\|.+\|[^\S\n]*$"),
)

# Spelling rules for OCR output: (pattern, replacement), applied in this order.
OCR_RULES = (
    (r"\bl\s+à\b", "là"),
    (r"\bc\s+ó\b", "có"),
    (r"\bt\s+ừ\b", "từ"),
    (r"\bđ\s+ược\b", "được"),
    (r"\bn\s+hư\b", "như"),
    (r"\bk\s+hi\b", "khi"),
    (r"\bv\s+ới\b", "với"),
    (r"\bs\s+ô\b", "số"),
    (r"\bm\s+ủ\b", "mủ"),
    (r"\bv\s+ự\b", "vự"),
    (r"\bt\s+ại\b", "tại"),
    (r"\bn\s+ên\b", "nên"),
    (r"\bth\s+ì\b", "thì"),
    (r"\btr\s+ong\b", "trong"),
    (r"\bch\s+o\b", "cho"),
    (r"\bc\s+ủa\b", "của"),
    (r"\bh\s+ay\b", "hay"),
    (r"\bv\s+à\b", "và"),
    (r"\bn\s+ày\b", "này"),
    (r"\bđ\s+ó\b", "đó"),
    (r"\bk\s+ể\b", "kể"),
    (r"\bt\s+ên\b", "tên"),
    (r"\bch\s+ưa\b", "chưa"),
    (r"\bđ\s+ã\b", "đã"),
    (r"\bm\s+ột\b", "một"),
    (r"\bh\s+ơn\b", "hơn"),
    (r"\bcũ\s+ng\b", "cũng"),
    (r"\bnh\s+ững\b", "những"),
    (r"\bđươc\b", "được"),
    (r"\bduợc\b", "được"),
    (r"\bđuợc\b", "được"),
    (r"\bnhư\s+ng\b", "nhưng"),
    (r"\btr\s+ên\b", "trên"),
    (r"\bdu\s+ới\b", "dưới"),
    (r"\bsa\s+u\b", "sau"),
    (r"\btr\s+ước\b", "trước"),
    (r"\bgi\s+ữa\b", "giữa"),
    (r"\bhi\s+ện\b", "hiện"),
    (r"\bth\s+ực\b", "thực"),
    (r"\bch\s+ính\b", "chính"),
    (r"\bΝιάς\b", "Nước"),
    (r"\b0\s+\b", "ở"),
    (r"\b1\s+à\b", "là"),
    (r"\bII\b", "II"),
    (r"\.\s+\b1\s+9", ".1.9"),
    (r"(\d+)\s+\.\s+(\d+)", "$1.$2"),
    (r"(\d+)\s+,\s+(\d+)", "$1,$2"),
    (r"\s+,", ","),
    (r"\s+\.", "."),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r"\bhoạ\s+t\b", "hoạt"),
    (r"\bkhô\s+ng\b", "không"),
    (r"\bthế\s+o\b", "theo"),
    (r"\bcá\s+c\b", "các"),
    (r"\bc h ứ a\b", "chữa"),
    (r"\bt h u ố c\b", "thuốc"),
    (r"\bb ệ n h\b", "bệnh"),
    (r"\bt á c\s+d ụ n g\b", "tác dụng"),
    (r"\bc h ấ t\b", "chất"),
    (r"\bc h ứ n g\b", "chứng"),
    (r"\bt h ể\b", "thể"),
    (r"\bc ơ\s+t h ể\b", "cơ thể"),
)

# Heading levels of lines without hashes.
HEADING_HASHES = r"(?U)^(#{1,6})\s+"
HEADING_LEVEL_TWO = r"(?iuU)^\d+\.\d+\s+|^[a-z]\)\s+|^[ivx]+\)\s+"
INLINE_BREAK_LINE = r"(?U)^\d+\.\d+\s"

# Inline spans of a line, in order of precedence.
INLINE_SPAN = (
    r"\$[^$\n]+\$|<sub>.*?</sub>|<sup>.*?</sup>|<[^>]+>|\*\*\*.*?\*\*\*|\*\*.*?\*\*|__.*?__|_.*?_|\*.*?\*"
    r"|`.*?`|\[.*?\]\(.*?\)"
)

# --- answers ------------------------------------------------------------------------------------
ANSWER_IMAGE = r"(?s)!\[.*?\]\(.*?\)"
ANSWER_LABEL = r"(?iuU)(?:Hình ảnh:|Images:)\s*"
ANSWER_DATA_URL = r"(?U)data:image/[a-zA-Z]+;base64,[^\s\)]+"
ANSWER_BLANK_RUN = r"(?U)\n\s*\n"
ANSWER_MAX_CHARS = 3000
ANSWER_CUT_NOTE = "\n...(truncated for safety)"
FAILED_ANSWER_PHRASES = ("không tìm thấy dữ liệu", "tôi không biết")
SOURCES_LABEL = "nguồn:"
IMAGES_LABEL = "Hình ảnh:"

# --- questions and names ------------------------------------------------------------------------
NAME_STOPWORDS = (
    "cay", "nhin", "trong", "ra", "sao", "nhu", "the", "nao", "giong", "dang",
    "hinh", "anh", "cho", "xem", "minh", "hoa", "cua", "la", "co",
)
FOCUS_WORD = "cay"
PICTURE_QUESTION = (
    r"(?iuU)botanical\s*[_-]?\s*features"
    r"|đặc\s*điểm\s*(thực\s*vật|hình\s*thái)"
    r"|mô\s*tả\s*(cây|thân|lá|hoa|quả)"
    r"|hình\s*dáng\s*(cây|thân|lá|hoa|quả)"
    r"|đặc\s*điểm\s*(thân|lá|hoa|quả)"
    r"|(nhìn|trông)\s*(ra\s*sao|như\s*thế\s*nào)"
    r"|(cho\s*(xem|mình)\s*)?(ảnh|hình)\s*(cây|của\s*cây)?"
    r"|hình\s*minh\s*họa"
)

# --- routing and retrieval ----------------------------------------------------------------------
BUCKETS = ("herbs", "diseases", "remedies", "emergency")
LEGACY_BUCKETS = {
    "herbs_plants": "herbs",
    "herbs_vegetables": "herbs",
    "endocrine_plants": "herbs",
    "endocrine_syndromes": "diseases",
    "remedies": "remedies",
}
BOOST_WORDS = ("cây", "rau", "ăn", "nấu", "luộc", "xào", "canh", "món")
BOOST_BUCKET = "herbs"
BOOST = 0.04
BUCKET_TOP_K = {"herbs": 3, "diseases": 3, "remedies": 3, "emergency": 2}
ROUTE_TEXT = {
    "herbs": "Thảo dược, cây thuốc, cây cảnh và rau làm thuốc: tên cây, đặc điểm thực vật, "
    "bộ phận dùng, công dụng, chỉ định (trị bệnh gì), cách dùng và lưu ý.",
    "diseases": "Bệnh lý, hội chứng và triệu chứng: các bệnh nội tiết, chuyển hóa, "
    "triệu chứng lâm sàng, nguyên nhân, nguyên tắc điều trị và hướng dùng thuốc.",
    "remedies": "Bài thuốc và công thức: thành phần (vị thuốc), liều lượng, cách sắc, "
    "cách pha chế, cách dùng, đối tượng sử dụng và các lưu ý khi dùng thuốc.",
    "emergency": "Cấp cứu và ngộ độc: xử trí khẩn cấp cho rắn cắn, say nắng, sốc, chảy máu, "
    "bỏng, ngộ độc hóa chất (paraquat) và các kỹ thuật sơ cứu cơ bản.",
}
CONTEXT_FIELDS = ("chemical_composition", "scientific_name", "family", "other_names")
CONTEXT_RULE = "\n\n---\n\n"
CONTEXT_MAX = 4
CONTEXT_MAX_CHARS = 1200
CONTEXT_MIN_CHARS_LIMIT = 200
NO_CONTEXT_ANSWER = "Không tìm thấy dữ liệu phù hợp trong chỉ mục."
ANSWER_SYSTEM = (
    "Bạn là trợ lý y học cổ truyền. Trả lời ngắn gọn, đúng trọng tâm, dựa trên ngữ cảnh cung cấp. "
    "Nếu ngữ cảnh không đủ, hãy nói rõ không đủ thông tin thay vì bịa."
)
ANSWER_CONTEXT_HEAD = "NGỮ CẢNH (trích từ kho dữ liệu):\n"
ANSWER_QUESTION_HEAD = "CÂU HỎI: "
ANSWER_RULES = (
    "YÊU CẦU:\n"
    "- Trả lời bằng tiếng Việt.\n"
    "- CHỈ sử dụng thông tin từ NGỮ CẢNH trên. KHÔNG dùng kiến thức bên ngoài.\n"
    "- Nếu là câu hỏi về đặc điểm cây, ưu tiên thông tin từ phần 'Features:' (botanical_features).\n"
    "- Nếu có thể, kết thúc bằng 1 dòng 'Nguồn:' liệt kê id hoặc source đã dùng.\n"
)

# --- images -------------------------------------------------------------------------------------
IMAGE_MAX_BYTES = 250_000
IMAGE_URL_MARKDOWN = r"!\[[^\]]*\]\(([^\)]+)\)"
IMAGE_URL_HTML = r"""(?i)<img[^>]+src=["']([^"']+)["']"""
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".gif")
IMAGE_FOLDER = "extracted_images"
NEAR_LINES = 30
NEAR_IMAGES = 3
MIME_BY_SUFFIX = (
    ("webp", "image/webp"),
    ("jpg", "image/jpeg"),
    ("jpeg", "image/jpeg"),
    ("png", "image/png"),
    ("gif", "image/gif"),
)

# --- evaluation and metrics ---------------------------------------------------------------------
SCORE_METRICS = ("context_recall", "answer_correctness", "faithfulness", "answer_relevancy")
EQUAL_BAND = 0.001
QUESTION_COLUMN = "Câu hỏi"
REFERENCE_COLUMN = "Đáp án"
DIFFICULTY_COLUMN = "Độ khó"
UNKNOWN_DIFFICULTY = "Unknown"
DIGITAL_MIN_CHARS = 10
DIGITAL_MIN_DENSITY = 0.001
SIZE_UNITS = ("B", "KB", "MB", "GB")
SIZE_LAST_UNIT = "TB"
FIRST_LINE_HEIGHT_FLOOR = 8

# --- extraction prompt --------------------------------------------------------------------------
EXTRACTION_HEAD = (
    "\nBạn là chuyên gia trích xuất dữ liệu tiếng Việt từ văn bản OCR (y học/cây thuốc). "
    "Nhiệm vụ: tạo JSON đúng schema.\n\nNgữ cảnh (nếu có): "
)
EXTRACTION_RULES = """Yêu cầu bắt buộc:
1) Chỉ xuất ra MỘT đối tượng JSON hợp lệ (không kèm giải thích, không markdown, không code fence).
2) JSON phải khớp schema bên dưới và có thể được validate.
3) KHÔNG bịa thông tin: chỉ dùng thông tin có trong văn bản OCR.
4) Không tạo thêm key ngoài schema. Danh sách key hợp lệ (top-level): <fields>
5) Kiểu dữ liệu nghiêm ngặt theo schema:
   - Field kiểu List luôn là mảng JSON (kể cả rỗng: [])
   - Field Optional có thể là null khi không có thông tin
   - Field bắt buộc:
       - Nếu là string: dùng "" khi không có thông tin
       - Nếu là List: dùng [] khi không có thông tin
       - Nếu là object bắt buộc: tạo object tối thiểu theo schema và không bịa nội dung
6) Dọn nhiễu OCR: nếu văn bản có câu/đoạn trùng lặp, chỉ giữ một lần trong nội dung trích xuất.
7) Giữ nguyên thuật ngữ tiếng Việt, không dịch.
"""
