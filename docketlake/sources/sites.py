"""Addresses and markers of the courts' sites.

All of these are fixed values: record columns are built from them.
"""

SUPREME_BASE = "https://www.supremecourt.gov.pk"
LAHORE_HOST = "https://sys.lhc.gov.pk"
LAHORE_PDF_BASE = "https://sys.lhc.gov.pk/appjudgments"
SINDH_BASE = "https://caselaw.shc.gov.pk/caselaw"
ISLAMABAD_BASE = "https://mis.ihc.gov.pk"
BALOCHISTAN_API = "https://api.bhc.gov.pk"
SHARIAT_BASE = "https://www.federalshariatcourt.gov.pk"
COMMONLII_BASE = "https://www.commonlii.org"
COMMONLII_CASES = "/pk/cases/PKSC"

MAINTENANCE_MARKERS = [
    "Site Under Maintenance",
    "We'll Be Back Soon",
    "currently down for maintenance",
]

COURT_BENCH_TYPES = [21, 31]

SINDH_JUDGES = {
    844: "Zafar Ahmed Rajput",
    883: "Muhammad Iqbal Kalhoro",
    965: "Mahmood A. Khan",
    966: "Muhammad Faisal Kamal Alam",
    1023: "Muhammad Saleem Jessar",
    1041: "Arshad Hussain Khan",
    1061: "Adnan-ul-Karim Memon",
    1101: "Khadim Hussain Tunio",
    1102: "Yousuf Ali Sayeed",
    1121: "Omar Sial",
    1162: "Shamsuddin Abbasi",
    1181: "Agha Faisal",
    1182: "Amjad Ali Sahito",
    1201: "Adnan Iqbal Chaudhry",
    1242: "Abdul Mobeen Lakho",
    1243: "Zulfiqar Ali Sangi",
    1261: "Amjad Ali Bohio",
    1263: "Sana Akram Minhas",
    1264: "Jawad Akbar Sarwana",
    1266: "Muhammad Abdur Rahman",
    1267: "Arbab Ali Hakro",
    1301: "Miran Muhammad Shah",
    1302: "Tasneem Sultana",
    1303: "Riazat Ali Sahar",
    1304: "Muhammad Hasan (Akber)",
    1305: "Khalid Hussain Shahani",
    1306: "Abdul Hamid Bhurgri",
    1307: "Syed Fiaz Ul Hassan Shah",
    1308: "Jan Ali Junejo",
    1309: "Nisar Ahmed Bhanbhro",
    1310: "Ali Haider 'Ada'",
    1311: "Muhammad Osman Ali Hadi",
    1312: "Muhammad Jaffer Raza",
}
