"""Fixed values that results depend on: word lists, formats and constants. Order and multiplicity count."""

from __future__ import annotations

#: Month names, Indonesian and English, with abbreviations.
MONTHS = {
    "januari": 1, "februari": 2, "maret": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "agustus": 8, "september": 9, "oktober": 10, "november": 11, "desember": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "agu": 8, "ags": 8, "agt": 8, "sep": 9, "sept": 9, "okt": 10, "nov": 11, "des": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "august": 8, "october": 10, "december": 12, "aug": 8, "oct": 10, "dec": 12,
}

#: Words that label a total, by tier; a higher tier wins.
TOTAL_WORDS = {
    3: ["grand total", "total bayar", "total belanja", "total penjualan", "total akhir", "total tagihan", "jumlah bayar", "total pembayaran", "total amount", "amount due", "total paid", "total harga", "order total", "total charged", "amount charged", "amount paid", "balance due", "total due"],
    2: ["total", "jumlah", "netto", "net sales", "net total"],
    1: ["subtotal", "sub total", "tunai", "cash", "bayar", "dibayar", "debit", "kartu kredit", "credit card", "rp", "usd"],
}

#: Lines with one of these never hold the total.
NOT_TOTAL = ["kembali", "kembalian", "change", "diskon", "discount", "potongan", "hemat", "saving", "ppn", "pajak", "tax", "service charge", "poin", "point", "npwp", "no.", "telp", "phone", "kasir", "cashier", "member"]

#: Words that speak for a category; a word listed twice counts twice.
CATEGORY_WORDS = {
    "Makanan & Minuman": ["resto", "restoran", "cafe", "kafe", "coffee", "kopi", "warung", "warteg", "bakso", "ayam", "nasi", "mie", "food", "burger", "pizza", "kfc", "mcd", "mcdonald", "starbucks", "bakery", "roti", "dapur", "kitchen", "catering", "sate", "soto", "seafood", "dimsum", "boba", "juice", "es teh", "geprek", "cappucino", "cappuccino", "espresso", "latte", "croissant", "caffeine", "eatery", "bistro", "grill", "chicken", "kedai", "bakmi", "kitchen", "grabfood", "gofood", "shopeefood", "makanan", "minuman", "menikmati"],
    "Belanja Harian": ["indomaret", "alfamart", "alfamidi", "superindo", "hypermart", "transmart", "carrefour", "hero", "ranch market", "supermarket", "minimarket", "grosir", "swalayan", "toserba", "lotte", "grocery"],
    "Transportasi": ["grab", "gojek", "gocar", "goride", "bluebird", "blue bird", "taksi", "taxi", "parkir", "parking", "bensin", "pertamina", "shell", "spbu", "bbm", "pertalite", "pertamax", "tol", "kereta", "krl", "mrt", "lrt", "busway", "transjakarta", "damri", "bengkel"],
    "Kesehatan": ["apotek", "apotik", "kimia farma", "guardian", "century", "klinik", "rumah sakit", "dokter", "obat", "laboratorium", "pharmacy", "hospital", "medical", "dental", "gigi"],
    "Tagihan & Utilitas": ["pln", "listrik", "pdam", "indihome", "telkom", "wifi", "pulsa", "token listrik", "biznet", "first media", "myrepublic", "internet", "tagihan", "iuran"],
    "Perjalanan & Akomodasi": ["hotel", "airbnb", "garuda", "lion air", "citilink", "airasia", "batik air", "traveloka", "tiket.com", "penginapan", "villa", "resort", "bandara", "boarding pass", "guest house"],
    "Hiburan": ["bioskop", "cinema", "cgv", "cinepolis", "xxi", "netflix", "spotify", "karaoke", "game", "steam", "playstation", "wahana", "tiket masuk"],
    "Perlengkapan Kantor": ["atk", "gramedia", "stationery", "percetakan", "fotokopi", "toner", "tinta", "office", "kertas a4", "alat tulis"],
    "Elektronik": ["erafone", "ibox", "digimap", "elektronik", "laptop", "komputer", "handphone", "samsung", "xiaomi", "electronic city"],
}
OTHER_CATEGORY = "Lainnya"

#: Words of header lines that never name the merchant.
NOT_NAME = ["struk", "nota", "invoice", "receipt", "faktur", "kwitansi", "bukti", "customer copy", "merchant copy", "npwp", "terima kasih", "thank you", "welcome", "selamat datang", "tax invoice", "pembayaran"]

#: How a line of a mail names the merchant.
MERCHANT_STARTS = ["pesanan dari", "order from", "dipesan dari", "merchant", "restoran", "toko", "outlet", "store", "sold by", "penjual"]

#: Patterns of currency marks, money, addresses.
USD_MARK = r"(?i)(?<![A-Za-z])US\$|(?<![A-Za-z])USD(?![A-Za-z])|(?<![A-Za-z$])\$(?=\s?\d)"
IDR_MARK = r"(?i)(?<![A-Za-z])(?:Rp|IDR|rupiah)(?![A-Za-z])"
MONEY = r"\d[\d.,]*\d|\d"
ADDRESS = r"(?i)\b(jl\.?|jalan|blok|ruko|gedung|lantai|kav\.?|rt\.?\s*\d|rw\.?\s*\d|no\.?\s*\d)\b"
HEADER_ADDRESS = r"\b(jl|jalan|telp|tlp|phone|no\.?\s*\d)\b"
#: Patterns of dates; MONTH stands for the month names.
ISO_DATE = r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
DAY_NAME_DATE = r"\b(\d{1,2})[\s\-/.,]*((?i:MONTH))[\s\-/.,]*(\d{2,4})\b"
NAME_DAY_DATE = r"\b((?i:MONTH))\.?\s+(\d{1,2})(?i:st|nd|rd|th)?\s*,?\s*(\d{4})\b"
NUMERIC_DATE = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})\b"
#: Ends of lines.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Zero-width marks, arrows and dingbats, variation selectors, private use, emoji.
UNDRAWABLE = r"[\x{200b}-\x{200f}\x{feff}\x{2190}-\x{2bff}\x{fe00}-\x{fe0f}\x{e000}-\x{f8ff}\x{1f000}-\x{1faff}]"

#: Smallest rupiah total; how far an unlabelled amount may exceed the labelled one.
IDR_FLOOR, OVERRIDE = 100, "1.5"
#: Sizes in pixels of a report page; rows of an index page.
PAGE = {"width": 1494, "first": 1989, "next": 2089, "overlap": 40, "fit": 0.6, "index_rows": 38}
MIN_ATTACHMENT_BYTES = 8192
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "heic", "heif"]
CSV_HEADER = ["Date", "Category", "Expense Detail", "Amount", "Currency"]
