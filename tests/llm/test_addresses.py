"""Address matching on writings of a few towns."""

from plotwise.llm import addresses

TOWNS = [("100-1000", "嶺北県", "Reihoku", "暁嶺市", "Akatsukimine-shi", "霞ヶ丘", "Kasumigaoka"), ("1001001", "嶺北県", "Reihoku", "暁嶺市", "Akatsukimine-shi", "狐沢", "Kitsunezawa"), ("1001002", "嶺北県", "Reihoku", "碧湊区", "Aoiminato-ku", "霞ヶ丘", "Kasumigaoka"), ("1001003", "嶺北県", "Reihoku", "碧湊区", "Aoiminato-ku", "椿谷", "Tsubakitani")]
SAME = [
    ["嶺北県暁嶺市霞ヶ丘1-23-4", "〒100-1000 嶺北県　暁嶺市　霞が丘　一丁目二十三番四号", "暁嶺市字霞ケ丘１丁目２３番地の４　Xビル 5F", "1-23-4 Kasumigaoka, Akatsukimine-shi, Reihoku Prefecture", "Akatsukimine City, KASUMIGAOKA 1-chome 23-4", "嶺北県暁嶺市霞ヶ丘1-23-4", "嶺北縣暁嶺市霞ヶ丘１−２３−４"],
    ["嶺北県暁嶺市狐澤2丁目百五番10号", "〒1001001孤沢2-105-10", "2 chome-105-10 Kitsunezawa, Akatsukimine-shi"], ["碧湊区霞ヶ丘1-23-4", "Aoiminato-ku, Kasumigaoka 1-23-4"], ["碧湊区霞ヶ丘1-23-5"], ["碧湊区椿谷1-23-4", "碧湊椿谷1丁目23-4"], ["未知市新町1-2-3", "未知市新町1丁目2番3号"], ["未知市新町1-2-4"],
]


def test_same_place(spark):
    rows = [(f"{g}{k}", a, "t") for g, group in enumerate(SAME) for k, a in enumerate(group)]
    odd = [("x", None, "t"), (None, SAME[0][0], "t"), ("y", "", "t"), ("z", "嶺北県暁嶺市霞ヶ丘", "t"), rows[0], ("long", "長" * 5000 + "1-2-3", "t")]
    df = spark.createDataFrame(rows + odd, "id string, address string, town string")
    towns = spark.createDataFrame(TOWNS, "postal_code string, prefecture string, prefecture_latin string, city string, city_latin string, town string, town_latin string")
    got = [(r.id_a, r.id_b) for r in addresses.same_place(df, towns).collect()]
    want = {(f"{g}{a}", f"{g}{b}") for g, group in enumerate(SAME) for a in range(len(group)) for b in range(a + 1, len(group))}
    assert len(got) == len(set(got)) and set(got) == want
    assert addresses.same_place(df.limit(0), towns).count() == 0
