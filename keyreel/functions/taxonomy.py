"""Object classes, their groups, and the resolution of query terms to class ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyreel.errors import FrameError

# The 80 class labels of the COCO detection task, in id order.
CLASS_NAMES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed",
    "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven",
    "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)
# Other names of classes.
ALIASES = {
    "phone": "cell phone", "cellphone": "cell phone", "cell-phone": "cell phone", "tv": "tv", "aeroplane": "airplane", "motorbike": "motorcycle",
    "hotdog": "hot dog", "wineglass": "wine glass", "hair dryer": "hair drier", "hairdryer": "hair drier",
}
# Class ids of the groups, and the words for them.
GROUPS = {
    "people": (0,),
    "vehicles": tuple(range(1, 9)),
    "animals": tuple(range(14, 24)),
    "products": (*range(24, 29), *range(39, 56), *range(62, 71), *range(72, 80)),
}
GROUP_WORDS = {"people": "people", "person": "people", "animals": "animals", "animal": "animals", "vehicles": "vehicles", "vehicle": "vehicles", "products": "products", "product": "products"}


def _normal(term: str) -> str:
    return term.strip().lower().replace("_", " ")


def class_id(name: str) -> int | None:
    name = _normal(name)
    name = ALIASES.get(name, name)
    return CLASS_NAMES.index(name) if name in CLASS_NAMES else None


def class_name(class_id: Column) -> Column:
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    return F.coalesce(F.when(class_id >= 0, F.get(names, class_id.cast("int"))), F.concat(F.lit("object_"), class_id.cast("string")))


def group_of(class_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for g, ids in GROUPS.items():
        out = F.when(class_id.isin(*ids), g).otherwise(out)
    return out


def resolve(term: str) -> list[int]:
    """Class ids of a group word (these come first, so `person` is the group) or a class name."""
    word = _normal(term)
    if word in GROUP_WORDS:
        return list(GROUPS[GROUP_WORDS[word]])
    found = class_id(word)
    if found is None:
        raise FrameError("USAGE", f"unknown object class or group {term!r}", "use a class name, or people, animals, vehicles, products")
    return [found]


def dimension(spark: SparkSession) -> DataFrame:
    """class_id, class_name, group of the 80 classes."""
    d = spark.range(len(CLASS_NAMES)).select(F.col("id").cast("int").alias("class_id"))
    return d.withColumn("class_name", class_name(F.col("class_id"))).withColumn("group", group_of(F.col("class_id")))
