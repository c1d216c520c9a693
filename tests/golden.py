"""Fixture values of FIXTURES.md."""

F1_START = [int(x) for x in (
    "598,598,599,599,599,599,599,599,600,600,600,600,600,600,600,600,601,601,601,602,657,657,658,658,658,659,659,659,659,659,659,659,660,660,660,660,661,661,661,661,"
    "743,743,743,744,744,744,744,745,745,745,745,745,746,746,746,746,746,746,747,747,780,781,781,781,781,781,781,782,782,782,782,782,783,783,783,783,783,783,784,784,"
    "834,835,835,835,835,835,835,836,836,837,837,837,837,837,837,837,837,837,838,838"
).split(",")]
F1_WIDTH = [int(x) for x in (
    "89,99,32,32,41,58,60,95,33,34,39,47,65,72,76,77,55,64,85,45,55,99,32,33,58,45,47,72,76,77,85,95,39,60,65,89,32,34,41,64,41,58,99,32,55,72,95,32,34,39,64,76,45,60,"
    "65,77,85,89,33,47,89,32,34,41,55,60,72,32,33,64,85,99,45,47,58,65,76,77,39,95,45,47,55,60,64,76,89,58,72,32,34,39,41,65,77,85,95,99,32,33"
).split(",")]
F1_SITES = [600] * 20 + [659] * 20 + [746] * 20 + [781] * 20 + [837] * 20
#: position: (estAbund, relRank)
F1_ABUNDANCE = {
    598: (2, 22), 599: (5, 10), 600: (8, 2), 601: (3, 16), 602: (1, 25), 657: (2, 22), 658: (3, 16), 659: (7, 3), 660: (4, 13), 661: (4, 13),
    743: (3, 16), 744: (4, 13), 745: (5, 10), 746: (6, 7), 747: (2, 22), 780: (1, 25), 781: (6, 7), 782: (5, 10), 783: (6, 7), 784: (2, 22),
    834: (1, 25), 835: (6, 7), 836: (2, 22), 837: (9, 1), 838: (2, 22),
}
F2_START = [int(x) for x in "598,598,599,599,599,599,599,599,600,600,600,600,600,600,600,600,601,601,601,602,603,603,603,604,604,615,615,615,616,617,575,575,577,577,579,573,573,573,572,574".split(",")]
F2_END = [int(x) for x in "686,687,687,687,686,658,658,658,658,657,639,639,639,638,637,676,677,676,675,675,657,657,658,658,658,659,659,659,659,659,659,659,660,660,660,660,661,661,661,661".split(",")]
F2_BREAKS = [x for v in (687, 658, 639, 676, 603, 615, 575, 573) for x in [v] * 5]


def f1(spark):
    rows = [(i + 1, "chr1", s, s + w - 1, "+") for i, (s, w) in enumerate(zip(F1_START, F1_WIDTH, strict=True))]
    return spark.createDataFrame(rows, "row_id long, seqnames string, start long, end long, strand string")


def f2(spark):
    rows = [(i + 1, "chr1", s, e, "+" if i < 20 else "-") for i, (s, e) in enumerate(zip(F2_START, F2_END, strict=True))]
    return spark.createDataFrame(rows, "row_id long, seqnames string, start long, end long, strand string")
