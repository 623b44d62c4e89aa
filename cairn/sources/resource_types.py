"""The dimension of resource types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code, abbreviation, name, file extensions, and Y for types whose payload begins with a file name.
TYPES = """
00000000|UI|User Interface|ui.txt|
0A284D0B|WGRA|Wall Graph||
0B9EB87E|TRKS|Track Settings||
0BF999E7|LTXT|Lot Description||
0C1FE246|XMOL|Mesh Overlay XML|mesh_overlay.xml|
0C560F39|BINX|Binary Index||
0C7E9A76|JPEG|JPEG Image||
0C900FDB|POOL|Pool Surface||
0C93E3DE|XFMD|Face Modifier XML|face_mod.xml|
104F6A6E|BNFO|Business Info||
1C4A276C|TXTR|Texture Resource|6tx|
2026960B|XA|Audio||
25232B11|5SC|Scene Node|5sc|
2A51171B|3ARY|Array 3D||
2C1FD8A1|XTOL|Texture Overlay XML|texture_overlay.xml|
2C30E040|THUB|Fence Arch Thumbnail|fence_arch_thumb.jpg|
2C310F46|POPT|Popup Tracker||
2C43CBD4|THUB|Foundation Or Pool Thumbnail|pool_thumb.jpg|
2C488BCA|THUB|Dormer Thumbnail|dormer_thumb.jpg|
2CB230B8|XFNC|Fence XML|fence.xml|
3053CF74|SCOR|Sim Scores||
42434F4E|BCON|Simantics Behaviour Constants||Y
42484156|BHAV|Simantics Behaviour Function||Y
424D505F|BMP|Bitmap Image|bmp|Y
43415453|CATS|Catalog String||
43494745|CIGE|Image Link||
43545353|CTSS|Catalog Description||Y
44475250|DGRP|Draw Group||
46414345|FACE|Face Properties||
46414D68|FAMH|Family Data||
46414D49|FAMI|Family Information||
46434E53|FCNS|Global Tuning Values||
46574156|FWAV|Audio Reference||
474C4F42|GLOB|Global Data||Y
484F5553|HOUS|House Data||
49596978|TXMT|Material Definition|5tm|
49FF7D76|WRLD|World Database||
4B58975B|TMAP|Terrain Texture Map||
4C158081|XSTN|Skin Tone XML|skin_tone.xml|
4C697E5A|MMAT|Material Override||
4D51F042|CINE|Cinematic Scene|5cs|
4D533EDD|JPEG|JPEG Image|1.jpg|
4DCADB7E|XFLR|Floor XML|floor.xml|
4E474248|NGBH|Neighborhood Data||
4E524546|NREF|Name Reference||Y
4E6D6150|NMAP|Name Map||
4F424A44|OBJD|Object Data||Y
4F424A66|OBJF|Object Functions||Y
4F626A4D|OBJM|Object Metadata||
4F6FD33D|INIT|Inventory Item||
50414C54|PALT|Image Color Palette||
50455253|PERS|Sim Personal Information||
504F5349|POSI|Stack Script||
50544250|PTBP|Package Toolkit||
53494D49|SIMI|Sim Information||
534C4F54|SLOT|Object Slot||
53505232|SPR2|Sprites||Y
53545223|STR|Text List||Y
54415454|TATT|TATT||Y
54505250|TPRP|Edith Simantics Behaviour Labels||Y
5452434E|TRCN|Behaviour Constants Labels||
54524545|TREE|Edith Flowchart Trees|tree.txt|Y
54535053|GROP|Groups Cache||
54544142|TTAB|Pie Menu Functions||Y
54544173|TTAS|Pie Menu Strings||Y
584D544F|XMTO|Material Object XML|material_object.xml|
584F424A|XOBJ|Object Class Dump|object.1.xml|
61754C1B|SLUA|SimPE Object Lua||
6A97042F|5EL|Environment Cube Lighting||
6B943B43|2ARY|Array 2D||
6C4F359D|COLL|Collection||
6C589723|LOT|Lot Information||
6C93B566|XFNU|Face Neutral XML|face_neutral.xml|
6D619378|XNGB|Neighbourhood Object XML|neighbourhood_object.xml|
6D814AFE|WNTT|Wants Tree Item XML|wants_tree_item.xml|
6F626A74|MOBJT|Main Lot Objects||
7181C501|REWD|Unlockable Rewards|rewards.txt|
7B1ACFCD|AUDR|Audio Resource||
7BA3838C|GMND|Geometric Node|5gn|
856DDBAC|IMG|Image|img jpg jpeg png tga|
8A84D7B0|WLL|Wall Layer||
8C1580B5|XHTN|Hair Tone XML|hair_tone.xml|
8C31125E|THUB|Wall Thumbnail|wall_thumb.jpg|
8C311262|THUB|Floor Thumbnail|floor_thumb.jpg|
8C3CE95A|JPEG|JPEG Image|2.jpg|
8C870743|FAMT|Family Ties||
8C93BF6C|XFRG|Face Region XML|face_region.xml|
8C93E35C|XFCH|Face Archetype XML|face_arch.xml|
8CC0A14B|PMAP|Predictive Map||
8DB5E4C2|SFX|Sound Effects||
A2E3D533|KEYD|Accelerator Key Definitions|keys.txt|
AACE2EFB|SDSC|Sim Description||
AB4BA572|FPL|Fence Post Layer||
AB9406AA|ROOF|Roof Data||
ABCB5DA4|NHTG|Neighbourhood Terrain Geometry||
ABD0DC63|NHTR|Neighborhood Terrain||
AC06A66F|5LF|Linear Fog Lighting|5lf|
AC06A676|5DS|Draw State Lighting|5ds|
AC2950C1|THUB|Thumbnail|thumb.jpg|
AC4F8687|GMDC|Geometric Data Container|5gd gmdc|
AC506764|3IDR|3D ID Referencing File||
AC598EAC|XSIM|Sim Data XML||
AC8A7A2E|NID|Neighbourhood ID||
ACA8EA06|XROF|Roof XML|roof.xml|
ACE46235|STXR|Surface Texture||
ADEE8D84|NLO|Light Override|nlo|
BA353CE1|TSSG|TSSG System||
C9C81B9B|LGHT|Ambient Light|5al|
C9C81BA3|LGHT|Directional Light|5dl|
C9C81BA9|LGHT|Point Light|5pl|
C9C81BAD|LGHT|Spotlight|5sl|
CAC4FC40|SMAP|String Map||
CB4387A1|VERT|Vertex Layer||
CC30CDF8|THUB|Fence Thumbnail|fence_thumb.jpg|
CC364C2A|SREL|Sim Relations||
CC44B5EC|THUB|Modular Stair Thumbnail|modular_stair_thumb.jpg|
CC489E46|THUB|Roof Thumbnail|roof_thumbnail.jpg|
CC48C51F|THUB|Chimney Thumbnail|chimney_thumbnail.jpg|
CCA8E925|XWLL|Wall XML|wall.xml|
CCCEF852|LXNR|Facial Structure||
CD7FE87A|MATSHAD|Maxis Material Shader|matShad|
CD95548E|SWAF|Wants And Fears||
CDB467B8|CREG|Content Registry||
D1954460|PBOP|Pet Body Options||
E519C933|CRES|Creation Resource|5cr|
E86B1EEF|DIR|DBPF Directory|dir|
EA5118B0|FX|Effects Resource Tree|fx|
EBCF3E27|GZPS|Property Set||
EBFEE33F|SDNA|Sim DNA||
EBFEE342|VERS|Version Information||
EBFEE345|ATST|Audio Test Settings||
EC3126C4|THUB|Terrain Thumbnail|terrain_thumb.jpg|
EC44BDDC|HCAM|Hood Camera||
ED534136|LIFO|Level Information|6li|
ED7D7B4D|XWNT|Wants XML|wants.xml|
F03D464C|THUB|Awning Thumbnail|awning_thumb.jpg|
FA1C39F7|OBJT|Singular Lot Object||
FB00791E|ANIM|Animation|5an|
FC6EB1F7|SHPE|Shape|5sh|
"""

#: Names of the compression codes.
COMPRESSIONS = {0x0000: "Uncompressed", 0xFFFE: "Streamable", 0xFFFF: "RefPack", 0xFFE0: "Deleted", 0x5A42: "ZLib"}


def rows() -> list[tuple[int, str, str, list[str], bool]]:
    each = (line.split("|") for line in TYPES.strip().splitlines())
    return [(int(code, 16), abbr, name, extensions.split(), embedded == "Y") for code, abbr, name, extensions, embedded in each]


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "type_id long, abbreviation string, type_name string, extensions array<string>, embedded boolean")


def codes(abbreviations: list[str] | tuple[str, ...]) -> list[int]:
    """Codes of abbreviations; one abbreviation may have several."""
    return [code for code, abbr, *_ in rows() if abbr.upper() in {a.upper() for a in abbreviations}]


def with_types(resources: DataFrame) -> DataFrame:
    """resources with their types' columns; unknown codes stay, named by their hexadecimal digits."""
    known = resources.join(F.broadcast(dimension(resources.sparkSession)), "type_id", "left")
    code = F.lpad(F.hex("type_id"), 8, "0")
    return known.withColumns({"abbreviation": F.coalesce("abbreviation", code), "type_name": F.coalesce("type_name", F.concat(F.lit("Unknown("), code, F.lit(")"))), "embedded": F.coalesce("embedded", F.lit(False))})


def search_strings() -> Column:
    """What a type is found by: name, abbreviation, code and extensions."""
    return F.concat(F.array("type_name", "abbreviation", F.lpad(F.hex("type_id"), 8, "0")), F.coalesce("extensions", F.array().cast("array<string>")))


def has_extension(name: Column) -> Column:
    """Whether a file name ends in one of the type's extensions, or in the one for any resource."""
    return F.exists(F.array_append(F.col("extensions"), "simpe"), lambda e: name.endswith(F.concat(F.lit("."), e)))


#: Versions of a person's description by code, as people know them.
VERSION_LABELS = {
    0x18: "V18",
    0x19: "V19",
    0x1A: "V1a",
    0x1C: "V1c",
    0x1E: "V1e",
    0x1F: "V1f",
    0x20: "Base Game",
    0x22: "University",
    0x27: "V27",
    0x29: "Nightlife",
    0x2A: "Business",
    0x2C: "Pets",
    0x2D: "Castaway",
    0x2E: "Bon Voyage",
    0x2F: "Bon Voyage (Version 2)",
    0x33: "Free Time",
    0x35: "Apartment Life (pre-release)",
    0x36: "Apartment Life",
}


def version_label(version: Column) -> Column:
    """A version's label; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in VERSION_LABELS.items() for x in pair)), version)
