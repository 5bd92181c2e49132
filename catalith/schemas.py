"""The catalogue's tables: English names, columns and types, and the source columns they are loaded from."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"L": T.LongType(), "I": T.IntegerType(), "S": T.StringType(), "B": T.BinaryType()}
_VEHICLE = "series_id BAUREIHE_ID L|model_id MODELL_ID L|engine_id MOTOR_ID L|body_id KAROSSERIE_ID L|gearbox_id GETRIEBE_ID L"
_BUILT = "produced_from PRODDAT_AB I|produced_to PRODDAT_BIS I"
_COUNTRY = "country_id LAND_ID L|enabled LAND_OK I"
_NODE = "path_id ZUWEG_ID L|node_id KNOTEN_ID L|code KNOTEN_KZ S|sort KNOTEN_SORT I|name KNOTEN_BEZ S|help KNOTEN_HELP S|picture KNOTEN_GRAPH S|variant_kind VARIANT_ART I|variant_value VARIANT_WERT L|parent_id VATER_ID L|" + _COUNTRY
_APPLIES = f"path_id ZUWEG_ID L|node_id KNOTEN_ID L|{_VEHICLE}|{_BUILT}|security SECURITY I"
_BRIDGE = "node_id KNOTEN_ID L|doc_id INFOOBJ_ID L|security SECURITY I"
_BLOB = "id id S|path path S|content_type content_type S|data data B"

# fixed values: source table, and for each column its name, source column and type. A source name that ends in six
# zeros stands for a family with a document type number there; it becomes one table partitioned by doc_type_id.
_SOURCES = {
    "label": ("TBENENNUNG", "key KEY L|name BENENNUNG S"),
    "doc_type": ("TDOKART", "code DOKART_KZ S|id DOKART_ID L|sort DOKART_SORT I|name DOKART_BEZ S|key_length KEY_LENGTH I|min_length MIN_LENGTH I|method METHODE I|access ZUGRIFF L|group_label HGNAME S|subgroup_label UGNAME S|security SECURITY I|vehicle_required FZG_REQU I|print_type DRUCK_TYP I|lead_type LEITTYP I|" + _COUNTRY),
    "chassis_range": ("TFGSTNRK", "area BEREICH L|serial_from FGSTNRAB L|serial_to FGSTNRBIS L|type_id FZGTYP L|produced PRODDAT I"),
    "applicability": ("TFZGREFBR", f"doc_id INFOOBJ_ID L|lead_type LEITTYP I|{_VEHICLE}|{_BUILT}"),
    "doc_type_applicability": ("TFZGREFBR_DA", f"doc_type_id DOKART_ID L|{_VEHICLE}|{_BUILT}"),
    "chassis_document": ("TFZGREFFGNR", "doc_id INFOOBJ_ID L|area BEREICH L|serial_from FGSTNRAB L|serial_to FGSTNRBIS L"),
    "vehicle_type": ("TFZGTYP", f"type_id FZGTYP L|{_VEHICLE}|drive_id ANTRIEB_ID L|equipment AUSFRG S"),
    "vehicle_model": ("TFZGMODELL", f"series_id BAUREIHE_ID L|model_id MODELL_ID L|series_name BAUREIHE_LANG S|model_name MODELL_LANG S|engine_id MOTOR_ID L|body_id KAROSSERIE_ID L|{_BUILT}"),
    "vehicle_action": ("TFZG_AKTION", f"doc_id INFOOBJ_ID L|sort INFOOBJ_SORT I|published ERSCHDAT I|title AKTION_TITEL S|{_COUNTRY}"),
    "group_document": ("TGRR000000", _BRIDGE),
    "node_document": ("THGR000000", _BRIDGE),
    "group_all": ("TGRREFALL_DA", f"node_id KNOTEN_ID L|doc_type_id DOKART_ID L|security SECURITY I|{_VEHICLE}|{_BUILT}|{_COUNTRY}"),
    "hotspot": ("THOTSPOT", f"source_id INFOOBJ_ID_V L|number HOTSPOT_NR I|target_id INFOOBJ_ID_N L|{_COUNTRY}"),
    "document_file": ("TINFO_FILE", "doc_id INFOOBJ_ID L|device_type DEVICETYP S|device_code DEVICEKZ S|file_name INFO_FILENAME S"),
    "document": ("TINFO_OBJEKT", f"id INFOOBJ_ID L|code INFOOBJ_KZ S|sort INFOOBJ_SORT I|doc_type_id DOKART_ID L|das_type DAS_DOKUART S|das_object DAS_OBJEKT S|das_index DAS_INDEX I|title TITEL S|published ERSCHDAT I|security SECURITY I|{_COUNTRY}"),
    "document_ref": ("TINFO_REF", f"source_id INFOOBJ_ID_V L|target_id INFOOBJ_ID_N L|doc_type_id DOKART_ID L|{_COUNTRY}"),
    "nav_applicability": ("TKNHG000000", _APPLIES),
    "group_applicability": ("TKN_GR_REF", _APPLIES),
    "main_applicability": ("TKN_HG_REF", _APPLIES),
    "symptom_applicability": ("TKN_SY_REF", _APPLIES),
    "news": ("TNEWS", f"id NEWS_ID L|doc_id INFOOBJ_ID L|doc_type_id DOKART_ID L|published ERSCH_DATUM I|title NEWS_TITEL S|sort NEWS_SORT I|{_COUNTRY}"),
    "lead_type": ("TLEITTYP", "type_id FZGTYP L|lead_type LEITTYP I"),
    "symptom_document": ("TSYREFALL", _BRIDGE),
    "nav_node": ("TZUKN000000", _NODE),
    "path": ("TZUWEG", f"id ZUWEG_ID L|sort ZUWEG_SORT I|name ZUWEG_BEZ S|root ZUWEG_ROOT I|{_COUNTRY}"),
    "path_node": ("TZUWEGKNOTEN", _NODE),
    "country": ("TLANDCODE", "code LAND_KZ S|id LAND_ID L"),
    "doc_blob": ("DOCS", _BLOB),
    "image_blob": ("IMAGES", _BLOB),
}

# fixed values: sentinels
ENABLED, PUBLIC = 1, 0
ALL_VEHICLES = ANY_GEARBOX = GENERIC = 0
ROOT_GROUP = -1
SYMPTOM_PATH, SYMPTOM_PARENT, COMPONENTS, DIAGNOSIS = 1, 0, -1, -2
VARIANT_NONE, VARIANT_ENGINE, VARIANT_BODY, VARIANT_GEARBOX = 0, 3000, 4000, 5000
METHOD_FLAT = 5
PREFIXED_TYPE, PREFIX = 1600, "IB"


def _columns(spec: str) -> list[tuple[str, str, str]]:
    return [tuple(c.split(" ")) for c in spec.split("|")]


def _schema(name: str, spec: str) -> T.StructType:
    fields = [T.StructField(n, _TYPES[t]) for n, _, t in _columns(spec)]
    if name in PARTITIONED:
        fields.append(T.StructField("doc_type_id", T.LongType()))
    return T.StructType(fields)


PARTITIONED = tuple(name for name, (source, _) in _SOURCES.items() if source.endswith("000000"))
SCHEMAS = {name: _schema(name, spec) for name, (_, spec) in _SOURCES.items()}
# which tables of families were loaded
LOADED = "loaded_table"
SCHEMAS[LOADED] = T.StructType([T.StructField("name", T.StringType()), T.StructField("doc_type_id", T.LongType())])
SOURCE_COLUMNS = {name: {n: s for n, s, _ in _columns(spec)} for name, (_, spec) in _SOURCES.items()}


def source_table(source: str) -> tuple[str, int | None] | None:
    """The table and, for a family, the document type that a source table is loaded into; None if it is not known."""
    upper = source.upper()
    for name, (known, _) in _SOURCES.items():
        if known.upper() == upper and name not in PARTITIONED:
            return name, None
        stem = known[:-6]
        if name in PARTITIONED and upper.startswith(stem) and len(upper) == len(known) and upper[len(stem) :].isdigit():
            return name, int(upper[len(stem) :])
    return None
