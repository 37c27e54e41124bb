"""Lines of result books against what they say."""

from poolside.sources.books import read_books

BOOK = """Championnat
Epreuve 1, Messieurs, 50m Libre
MINIMA 13 - 14: 30.57; 15: 29.00
Séries
1. BENBARA, MEHDI NAZIM 98 MC ALGER 22.67 703
5. SAIDI, Ali 10 CLUB A 28.23 351
RAHMOUNI, Mahdi 12 Union Sportf Biskra 28.23 350
h.c. RAHMOUNI, Mahdi 12 Union Sportf Biskra 28.23 350
disq. TAIBI, Abderraouf 10 Club B 30.31
forfait  ZIDI, Omar 11 Club 2000
NC. NADIR, Sami 09 MCA 30.00
Finale
1. BENBARA, MEHDI NAZIM 98 MC ALGER 22.50 710
Epreuve 2 Dames
200m 4 nages
1. HADDAD, Lina04 GS 2:25.94 600 31.00 1:08.00
"""


def test_books(spark):
    rows = read_books(spark.createDataFrame([("a", BOOK), ("b", ""), ("c", None)], "book string, text string")).orderBy("line_no").collect()
    got = [(r["event"], r["gender"], r["round_type"], r["rank"], r["swimmer"], r["birth_year"], r["club"], r["time_cs"], r["points"], r["status"]) for r in rows]
    first = "50 M Freestyle", "M"
    assert got == [
        (*first, "Heats", 1, "Mehdi Nazim BENBARA", 1998, "MC ALGER", 2267, 703, "OK"),
        (*first, "Heats", 5, "Ali SAIDI", 2010, "CLUB A", 2823, 351, "OK"),
        (*first, "Heats", 5, "Mahdi RAHMOUNI", 2012, "Union Sportf Biskra", 2823, 350, "OK"),
        (*first, "Heats", 0, "Mahdi RAHMOUNI", 2012, "Union Sportf Biskra", 2823, 350, "HC"),
        (*first, "Heats", 0, "Abderraouf TAIBI", 2010, "Club B", 0, 0, "DSQ"),
        (*first, "Heats", 0, "Omar ZIDI", 2011, "Club 2000", 0, 0, "DNS"),
        (*first, "Heats", 0, "Sami NADIR", 2009, "MCA", 3000, 0, "OK"),
        (*first, "Finals", 1, "Mehdi Nazim BENBARA", 1998, "MC ALGER", 2250, 710, "OK"),
        ("200 M Individual Medley", "F", "", 1, "Lina HADDAD", 2004, "GS", 14594, 600, "OK"),
    ]
