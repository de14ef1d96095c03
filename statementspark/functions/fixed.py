"""They must be these for right results. Patterns use no look-around."""

# Channels in the order in which they are tried.
CHANNELS = [
    ("Interest", r"\bINT\.?\s*PD\b|\bCREDIT\s+INTEREST\b|\bINTEREST\s+(?:PAID|CREDIT)|\bSAVINGS?\s+INTEREST\b"),
    ("Charges", r"\bAMB\s*CHRG\b|\bCHRG(?:S|ES)?\b|\bCHARGES?\b|\bGST\b|\bSMS\s*CHG|\bANNUAL\s+FEE\b|\bPENAL\b|\bLATE\s+FEE\b|\bBOUNCE\b|\bNON\s*MAINTAIN"),
    ("ATM", r"^\s*(?:ATW|ATM|NWD|EAW)\b|\bCASH\s+WITHDRAWAL\b|\bATM\s+CASH\b|\bCASH\s+WDL\b"),
    ("UPI", r"^\s*UPI\b|\bUPI[/-]|\b(?:MOB|MMT)/(?:IMPS|UPI)\b|@(?:ybl|okaxis|oksbi|okhdfcbank|okicici|paytm|apl|ibl|axl)\b"),
    ("Cheque", r"\bCHQ\b|\bCHEQUE\b|\bCLG\b|\bINWARD\s+CLEARING\b"),
    ("Auto-debit", r"^\s*(?:ACH|NACH|ECS)\b|\bACH\s*[DC]\b|\bNACH\b|\bE-?MANDATE\b|^\s*SI[-/ ]"),
    ("Card", r"^\s*(?:POS|ECOM|IPS|VPS)\b|\bPOS\s+\d|\bCARD\s+(?:PURCHASE|PAYMENT)|\bMERCHANT\s+PURCHASE\b"),
    ("NEFT", r"\bNEFT\b"),
    ("RTGS", r"\bRTGS\b"),
    ("IMPS", r"\bIMPS\b"),
    ("Transfer", r"\bTRANSFER\s+(?:TO|FROM)\b|\bFUND\s+TRANSFER\b|\bSELF\b|\bTPT\b|\bBY\s+TRANSFER\b"),
]

# Narrations that are always one merchant.
CANONICAL = [
    ("Interest Credited", r"\bINT\.?\s*PD\b|\bCREDIT\s+INTEREST\b|\bINTEREST\s+(?:PAID|CREDIT)"),
    ("Minimum Balance Charge", r"\bAMB\s*CHRG\b|\bNON\s*MAINTAIN|\bMIN(?:IMUM)?\s+BAL(?:ANCE)?\s+CHARGE"),
    ("ATM Withdrawal", r"^\s*(?:ATW|ATM|NWD|EAW)\b|\bCASH\s+WITHDRAWAL\b|\bCASH\s+WDL\b"),
    ("SMS Alert Charges", r"\bSMS\s*(?:CHG|CHARGE)|\bALERT\s+CHARGES?\b"),
    ("Credit Card Payment", r"\bCREDIT\s*CARD\b|\bCC\s+(?:PAYMENT|BILL)\b|\bCARD\s+BILL\s+PAY"),
]

# Words that are never a merchant by themselves.
NOISE_WORDS = [
    "UPI", "DR", "CR", "POS", "NEFT", "IMPS", "RTGS", "ACH", "NACH", "ECS", "SI", "EMI", "CHQ", "CLG", "MMT", "MOB", "TPT", "ATW",
    "ATM", "NWD", "EAW", "ECOM", "IPS", "VPS", "PAYMENT", "PAYMENTS", "PAY", "PMT", "TXN", "TRANSACTION", "TRF", "TRANSFER", "REF",
    "REFNO", "RRN", "UTR", "COLLECT", "REQUEST", "SENT", "RECEIVED", "TO", "FROM", "BY", "THE", "AND", "FOR", "VIA", "INR", "RS", "AC",
    "ACC", "ACCT", "ACCOUNT", "NO", "NA", "MERCHANT", "PURCHASE", "ONLINE", "MOBILE", "BANKING", "NETBANKING", "IB", "IMB", "SERVICE",
    "SERVICES", "LTD", "LIMITED", "PVT", "PRIVATE", "INDIA", "IN", "OTHERS", "SUCCESS", "SUCCESSFUL", "DEBIT", "CREDIT", "WITHDRAWAL",
    "DEPOSIT", "AMT", "AMOUNT", "FOLIO", "MANDATE", "AUTOPAY", "AUTO", "BILL", "BILLDESK", "BBPS", "RECHARGE", "YOU", "ARE", "PAYI",
    "PAYIN", "PAYING", "USING", "RECD", "REV", "REVERSAL", "EXECUTION", "MANDATEEXECU", "MANDATEEXEC", "SUBSCRIPTION", "SUBSCRIPTI",
    "COMPLAIN", "COMPLAINT", "PAID", "SUP", "RAZO", "RAZORPAY", "MB",
]

# Short names of banks and payment providers.
BANK_CODES = [
    "HDFC", "HDFCBANK", "ICIC", "ICICI", "SBI", "SBIN", "AXIS", "AXISBANK", "UTIB", "KOTAK", "KKBK", "YESB", "YES", "IDFC", "IDFB",
    "INDB", "INDUSIND", "PNB", "PUNB", "BARB", "BOB", "CNRB", "CANARA", "UBIN", "UNION", "IOBA", "IDIB", "CITI", "CITIN", "SCBL",
    "HSBC", "DBSS", "RATN", "RBL", "AUBL", "FDRL", "FEDERAL", "KVBL", "TMBL", "PYTM", "PAYTMBANK", "APL", "IBL", "AXL", "OKAXIS",
    "OKSBI", "OKHDFCBANK", "OKICICI", "YBL", "NPCI", "BANK",
]

# Words that stay in capitals.
ACRONYMS = [
    "ATM", "UPI", "NEFT", "IMPS", "RTGS", "EMI", "SIP", "IRCTC", "PVR", "BSNL", "MTNL", "BESCOM", "MSEB", "BSES", "TATA", "HDFC",
    "ICICI", "SBI", "LIC", "HP", "BPCL", "HPCL", "IOCL", "KFC", "INOX", "OYO", "IKEA", "GST", "TDS", "NSE", "BSE", "DTH", "OTT", "AC",
    "PG", "IT",
]

# Patterns of tokens and narrations.
IFSC = r"^[A-Z]{4}0[A-Z0-9]{6}$"
MASKED_CARD = r"^\d{0,6}[Xx]{2,}\d{0,6}$"
MONTH_STAMP = r"^(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[-/]?\d{2,4}$"
DATE_LIKE = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"
VPA = r"\b([A-Za-z0-9_.\-]{2,})@([A-Za-z]{2,})\b"
PREFIX = r"^\s*(?:REV[\s/-]*)?(?:UPI|POS|ECOM|NEFT|IMPS|RTGS|ACH\s*[DC]?|NACH\s*[DC]?|ECS|SI|MMT|TPT|IB)[\s/:-]+"
CARD_INSIDE = r"\b\d{0,6}X{2,}\d{0,6}\b"
LONG_NUMBER = r"\b\d{12,}\b"
MONEY = r"(?:\d{1,3}(?:,\d{2,3})*\.\d{2}|\d+\.\d{2})"
UPI_LAYOUT = r"(?i)^\s*(?:REV[\s/-]*)?UPI[/-]"
SEPARATORS = r"[/|:;,\\-]+"
REFUND = r"(?i)\brefund|\breversal|\breversed\b|\bcashback\b|\bchargeback\b|\bcredit\s+adj"
AMOUNT = r"(?i)^\(?\s*(?:inr|rs\.?|₹)?\s*([+-]?\d[\d,]*(?:\.\d+)?)\s*(?:cr|dr)?\s*\)?$"
CLOCK = r"(?i)[\s,]+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]\.?m\.?)?\s*$"
BOILERPLATE = r"statement of account|page \d+|registered office|customer id|ifsc|micr|account (?:no|number)|opening balance|closing balance|this is a computer"
JUNK = r"^(?:total|grand total|opening balance|closing balance|b/?f|c/?f|statement summary|page \d+)"
FLAG = r"(?i)^\s*(?:dr|cr|d|c|debit|credit|withdrawal|deposit|wdl|dep)\s*$"
LEADING_DATE = r"^\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{1,2}[\-\s][A-Za-z]{3}[\-\s]\d{2,4})\s+"
TRAILING_DATE = r"\s+(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})\s*$"

# Date formats in the order of preference, as Spark writes them.
DATE_FORMATS = ["d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy", "d-MMM-yyyy", "d MMM yyyy", "d-MMM-yy", "d MMM yy", "d/MMM/yyyy", "yyyy-M-d", "d.M.yyyy", "d.M.yy"]

# Categories, Uncategorised last.
CATEGORIES = [
    "Food & Dining", "Groceries", "Transport & Fuel", "Shopping", "Bills & Utilities", "Rent & Housing", "Health & Medical",
    "Entertainment & Subscriptions", "Travel", "Education", "Insurance", "Investments & SIP", "Loan & EMI", "Fees & Charges",
    "Cash Withdrawal", "Transfers", "Income", "Uncategorised",
]
UNCATEGORISED = "Uncategorised"
NOT_SPENDING = ["Transfers", "Investments & SIP", "Income"]
#: Families of models by the start of their name.
MODEL_FAMILIES = {"claude": "Claude", "gpt": "OpenAI", "chatgpt": "OpenAI", "o1": "OpenAI", "o3": "OpenAI", "o4": "OpenAI", "o5": "OpenAI"}
OTHER_MODEL = "AI"
SOURCE_LABELS = {"override": "You tagged it", "cache": "Learned", "rule": "Rule", "heuristic": "Heuristic", "llm": "AI", "none": "Unresolved"}

# Cadence windows in days, monthly factors, and limits.
CADENCES = [("Weekly", 6, 8), ("Fortnightly", 13, 16), ("Monthly", 26, 35), ("Quarterly", 85, 95), ("Half-yearly", 175, 190), ("Yearly", 355, 375)]
PER_MONTH = {"Weekly": "52/12", "Fortnightly": "26/12", "Monthly": "1", "Quarterly": "1/3", "Half-yearly": "1/6", "Yearly": "1/12"}
DAYS_PER_MONTH = 30.44
TOLERANCE = 0.02

# Header words of each field, most telling first.
HEADERS = {
    "date": ["transaction date", "txn date", "tran date", "posting date", "value date", "value dt", "date"],
    "description": ["transaction remarks", "transaction description", "transaction details", "narration", "particulars", "description", "remarks", "details", "narrative"],
    "debit": ["withdrawal amt", "withdrawal amount", "withdrawal (dr)", "debit amount", "withdrawal", "withdrawl", "debit", "paid out", "dr amount", "dr"],
    "credit": ["deposit amt", "deposit amount", "deposit (cr)", "credit amount", "deposit", "credit", "paid in", "cr amount", "cr"],
    "balance": ["closing balance", "running balance", "available balance", "balance amount", "balance (inr)", "balance", "bal"],
    "amount": ["transaction amount", "amount (inr)", "amount", "amt"],
    "drcr": ["dr / cr", "dr/cr", "cr/dr", "type", "indicator", "transaction type"],
}
NOT_HEADERS = r"(?i)cheque|chq|ref(?:erence)?\s*(?:no|number|num)|serial|sl\.?\s*no|s\.?\s*no\b|branch|instrument|utr"
