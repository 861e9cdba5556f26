"""The languages a model can be trained for: charsets, alphabets, and pages to start a crawl for texts from."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARABIC = "".join(map(chr, range(0x0621, 0x0652)))
_HEBREW = "".join(map(chr, [*range(0x05D0, 0x05EB), *range(0x05F0, 0x05F3)]))
_THAI = "".join(map(chr, [*range(0x0E01, 0x0E3B), *range(0x0E3F, 0x0E5C)]))
_WEST = ["ISO-8859-1", "ISO-8859-15", "WINDOWS-1252", "MacRoman"]
_CENTRAL = ["ISO-8859-2", "WINDOWS-1250"]
_BALTIC = ["ISO-8859-13", "WINDOWS-1257", "ISO-8859-4"]

#: (name, code, whether ASCII letters belong to it beside the alphabet, charsets, alphabet, start pages). Fixed values.
LANGUAGES = [
    ("Arabic", "ar", False, ["ISO-8859-6", "WINDOWS-1256", "CP720", "CP864"], _ARABIC, ["الصفحة_الرئيسية"]),
    ("Belarusian", "be", False, ["ISO-8859-5", "WINDOWS-1251", "IBM866", "MacCyrillic"], "АБВГДЕЁЖЗІЙКЛМНОПРСТУЎФХЦЧШЫЬЭЮЯабвгдеёжзійклмнопрстуўфхцчшыьэюяʼ", ["Галоўная_старонка"]),
    ("Bulgarian", "bg", False, ["ISO-8859-5", "WINDOWS-1251", "IBM855"], "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЬЮЯабвгдежзийклмнопрстуфхцчшщъьюя", ["Начална_страница"]),
    ("Croatian", "hr", False, _CENTRAL, "abcčćdđefghijklmnoprsštuvzžABCČĆDĐEFGHIJKLMNOPRSŠTUVZŽ", ["Glavna_stranica"]),
    ("Czech", "cz", True, _CENTRAL, "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", ["Hlavní_strana"]),
    ("Danish", "da", True, _WEST, "æøåÆØÅ", ["Forside"]),
    ("Dutch", "nl", True, ["ISO-8859-1", "WINDOWS-1252", "MacRoman"], "", ["Hoofdpagina"]),
    ("English", "en", True, ["ISO-8859-1", "WINDOWS-1252", "MacRoman"], "", ["Main_Page"]),
    ("Esperanto", "eo", False, ["ISO-8859-3"], "abcĉdefgĝhĥijĵklmnoprsŝtuŭvzABCĈDEFGĜHĤIJĴKLMNOPRSŜTUŬVZ", ["Vikipedio:Ĉefpaĝo"]),
    ("Estonian", "et", False, ["ISO-8859-4", "ISO-8859-13", "WINDOWS-1257"], "ABDEGHIJKLMNOPRSTUVÕÄÖÜabdeghijklmnoprstuvõäöü", ["Esileht"]),
    ("Finnish", "fi", True, _WEST, "ÅÄÖŠŽåäöšž", ["Wikipedia:Etusivu"]),
    ("French", "fr", True, _WEST, "œàâçèéîïùûêŒÀÂÇÈÉÎÏÙÛÊ", ["Wikipédia:Accueil_principal", "Bœuf (animal)"]),
    ("German", "de", True, _WEST, "äöüßẞÄÖÜ", ["Wikipedia:Hauptseite"]),
    ("Greek", "el", False, ["ISO-8859-7", "WINDOWS-1253"], "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ", ["Πύλη:Κύρια"]),
    ("Hebrew", "he", False, ["ISO-8859-8", "WINDOWS-1255"], _HEBREW, ["עמוד_ראשי"]),
    ("Hungarian", "hu", False, _CENTRAL, "abcdefghijklmnoprstuvzáéíóöőúüűABCDEFGHIJKLMNOPRSTUVZÁÉÍÓÖŐÚÜŰ", ["Kezdőlap"]),
    ("Italian", "it", True, _WEST, "ÀÈÉÌÒÓÙàèéìòóù", ["Pagina_principale"]),
    ("Latvian", "lv", False, _BALTIC, "AĀBCČDEĒFGĢHIĪJKĶLĻMNŅOPRSŠTUŪVZŽaābcčdeēfgģhiījkķlļmnņoprsštuūvzž", ["Sākumlapa"]),
    ("Lithuanian", "lt", False, _BALTIC, "AĄBCČDEĘĖFGHIĮYJKLMNOPRSŠTUŲŪVZŽaąbcčdeęėfghiįyjklmnoprsštuųūvzž", ["Pagrindinis_puslapis"]),
    ("Macedonian", "mk", False, ["ISO-8859-5", "WINDOWS-1251", "MacCyrillic", "IBM855"], "АБВГДЃЕЖЗЅИЈКЛЉМНЊОПРСТЌУФХЦЧЏШабвгдѓежзѕијклљмнњопрстќуфхцчџш", ["Главна_страница"]),
    ("Polish", "pl", False, _CENTRAL, "AĄBCĆDEĘFGHIJKLŁMNŃOÓPRSŚTUWYZŹŻaąbcćdeęfghijklłmnńoóprsśtuwyzźż", ["Wikipedia:Strona_główna"]),
    ("Portuguese", "pt", True, _WEST, "ÁÂÃÀÇÉÊÍÓÔÕÚáâãàçéêíóôõú", ["Wikipédia:Página_principal"]),
    ("Romanian", "ro", True, _CENTRAL, "ăâîșțĂÂÎȘȚ", ["Pagina_principală"]),
    ("Russian", "ru", False, ["ISO-8859-5", "WINDOWS-1251", "KOI8-R", "MacCyrillic", "IBM866", "IBM855"], "абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", ["Заглавная_страница"]),
    ("Serbian", "sr", True, ["ISO-8859-5", "WINDOWS-1251", "MacCyrillic", "IBM855"], "АБВГДЂЕЖЗИЈКЛЉМНЊОПРСТЋУФХЦЧЏШабвгдђежзијклљмнњопрстћуфхцчџш", ["Главна_страна"]),
    ("Slovak", "sk", True, _CENTRAL, "áäčďéíĺľňóôŕšťúýžÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ", ["Hlavná_stránka"]),
    ("Slovene", "sl", False, _CENTRAL, "abcčdefghijklmnoprsštuvzžABCČDEFGHIJKLMNOPRSŠTUVZŽ", ["Glavna_stran"]),
    ("Spanish", "es", True, _WEST, "ñáéíóúüÑÁÉÍÓÚÜ", ["Wikipedia:Portada"]),
    ("Thai", "th", False, ["ISO-8859-11", "TIS-620", "CP874"], _THAI, ["หน้าหลัก"]),
    ("Turkish", "tr", False, ["ISO-8859-3", "ISO-8859-9", "WINDOWS-1254"], "abcçdefgğhıijklmnoöprsştuüvyzâîûABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZÂÎÛ", ["Ana_Sayfa"]),
    ("Vietnamese", "vi", False, ["WINDOWS-1258"], "aăâbcdđeêghiklmnoôơpqrstuưvxyAĂÂBCDĐEÊGHIKLMNOÔƠPQRSTUƯVXY", ["Chữ_Quốc_ngữ"]),
]

SCHEMA = "name string, iso_code string, use_ascii boolean, charsets array<string>, letters string, start_pages array<string>"


def alphabet(letters: Column, use_ascii: Column) -> Column:
    """The letters once each in the order of code points, with ASCII's where they belong to the language."""
    joined = F.concat(F.coalesce(letters, F.lit("")), F.when(use_ascii, F.lit(ascii_letters)).otherwise(F.lit("")))
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit("(?s)(.)")))), "")


def catalogue(spark: SparkSession, languages: list[tuple] | None = None) -> DataFrame:
    """A row for each language. ValueError for one without any letters."""
    rows = LANGUAGES if languages is None else languages
    bare = [r[0] for r in rows if not r[2] and not r[4]]
    if bare:
        raise ValueError(f"languages without letters: {', '.join(map(str, bare))}")
    table = spark.createDataFrame(rows, SCHEMA)
    return table.select("name", "iso_code", "use_ascii", "charsets", alphabet(F.col("letters"), F.col("use_ascii")).alias("alphabet"), "start_pages")
