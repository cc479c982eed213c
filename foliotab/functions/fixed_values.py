"""Fixed values.

Word lists, column names, patterns and limits that must equal the service's own for its
results to be right.  They are data, kept together and in natural order.
"""

from __future__ import annotations

from .text import EDGE_L, EDGE_R

# --- schemas ---------------------------------------------------------------

LINE_COLUMNS = ["Página", "Línea", "Texto"]

ROSTER_COLUMNS = ["Numero", "NombreApellido", "CUIL", "LugarTrabajo", "Localidad", "Provincia"]

COMPANY_COLUMNS = ["Empresa", "CUIT", "NombreApellido", "DNI", "Provincia", "Localidad"]

SUPPLIER_COLUMNS = [
    "Nombre empresa", "Proveedor", "CUIT", "Servicio/Área", "Provincia", "Zona de radicación",
    "Fecha/Periodo de contratación", "Modalidad de contratación",
]

MOVEMENT_COLUMNS = [
    "FechaSalida", "CantidadCamion", "Unidad", "Tons", "Proveedor", "Producto", "Origen",
    "RutaCaminosPuna", "Destino", "FechaArribo", "CantidadEscoltas",
]

COMMERCIAL_COLUMNS = [
    "TipoDocumento", "Organismo", "NumeroDocumento", "CUVE", "CADTV", "FechaEmision", "FechaCarga",
    "FechaVencimiento", "Motivo", "Emisor", "CUITEmisor", "Receptor", "CUITReceptor",
    "DomicilioOrigen", "LocalidadOrigen", "ProvinciaOrigen", "DomicilioDestino",
    "LocalidadDestino", "ProvinciaDestino", "Producto", "Variedad", "Acondicionamiento",
    "Cantidad", "Peso", "Unidad", "Total", "Importe", "FormaPago", "Transportista",
    "CUITTransportista", "PatenteChasis", "PatenteAcoplado", "CodigoCierre", "Observaciones",
]

SECTION_COLUMNS = [
    "Sección", "Categoría", "Dato", "Valor", "Detalle", "Fecha", "Expediente/Resolución",
    "Empresa/Proyecto", "Ubicación", "Observación",
]

ANNEX_COLUMNS = [
    "N° Anexo", "Nombre Anexo", "Romano", "N° Punto", "Frecuencia", "Tipo de Plazo", "Cant. Días",
]

CHUNK_COLUMNS = [
    "Sección", "Tipo de dato", "Título", "Descripción", "Fecha", "Expediente", "Empresa",
    "Volumen", "Cantidad", "Estado", "Riesgo", "Decisión/Recomendación", "Página",
]

# --- column aliases --------------------------------------------------------

COMMERCIAL_ALIASES = {
    "numerodocumento": ["numerodocumento", "ndocumento", "documentonumero", "nrodocumento"],
    "fechaemision": ["fechaemision", "fecha"],
    "peso": ["peso", "pesototal", "pesoneto", "pesobruto"],
    "producto": ["producto", "productouso", "productoservicio"],
    "patentechasis": ["patentechasis", "patente", "dominiochasis"],
    "patenteacoplado": ["patenteacoplado", "dominioacoplado"],
    "codigocierre": ["codigocierre", "codigo"],
    "cuitemisor": ["cuitemisor", "cuitemitente"],
    "cuitreceptor": ["cuitreceptor", "cuitdestinatario"],
    "cuittransportista": ["cuittransportista"],
}

COMMERCIAL_QUALITY_KEYS = [
    "acondicionamiento", "cadtv", "codigocierre", "comprobante", "cuit", "cuitemisor",
    "cuitreceptor", "cuittransportista", "cuve", "domiciliodestino", "domicilioorigen", "emisor",
    "fecha", "fechacarga", "fechaemision", "fechavencimiento", "formapago", "importe",
    "localidaddestino", "localidadorigen", "motivo", "numerodocumento", "organismo", "patente",
    "patenteacoplado", "patentechasis", "peso", "pesototal", "producto", "productouso",
    "provinciadestino", "provinciaorigen", "receptor", "tipodocumento", "total", "transportista",
    "unidad", "variedad", "observaciones",
]

MOVEMENT_QUALITY_KEYS = [
    "fechasalida", "cantidadcamion", "unidad", "tons", "proveedor", "producto", "origen",
    "rutacaminospuna", "destino", "fechaarribo", "cantidadescoltas",
]

SECTION_QUALITY_COLUMNS = [
    "seccion", "categoria", "dato", "valor", "detalle", "fecha", "expediente resolucion",
    "empresa proyecto", "ubicacion", "observacion",
]

GENERIC_QUALITY_COLUMNS = ["pagina", "linea", "texto", "estado", "mensaje"]

SUPPLIER_HEADER_ALIASES = {
    "Nombre empresa": ["nombre empresa", "empresa", "razon social"],
    "Proveedor": ["proveedor", "nombre proveedor"],
    "CUIT": ["cuit"],
    "Servicio/Área": ["servicio/area", "servicio area", "area/servicio"],
    "Provincia": ["provincia", "provin"],
    "Zona de radicación": ["zona de radicacion", "radicacion"],
    "Fecha/Periodo de contratación": [
        "fecha/periodo de contratacion", "fecha periodo de contratacion", "periodo de contratacion",
    ],
    "Modalidad de contratación": [
        "modalidad contratacion", "modalidad de contratacion", "modalidal contratacion",
    ],
}

LIST_KIND_COLUMNS = ["razonsocial", "cuit", "localidad", "actividadprincipal"]
COMMERCIAL_KIND_COLUMNS = [
    "tipodocumento", "organismo", "numerodocumento", "cuve", "cadtv", "cuitemisor", "cuitreceptor",
    "producto", "pesototal", "transportista", "patentechasis", "patenteacoplado", "codigocierre",
]
TECHNICAL_KIND_COLUMNS = [
    "seccion", "categoria", "dato", "valor", "expedienteresolucion", "empresaproyecto", "ubicacion",
]
SUPPLIER_KIND_COLUMNS = ["nombreempresa", "proveedor", "cuit", "servicioarea"]
MOVEMENT_KIND_COLUMNS = ["fechasalida", "cantidadcamion", "rutacaminospuna"]

VISUAL_METADATA_KEYS = ["confidence", "warning", "warnings", "rowconfidence", "orientation"]

# --- gazetteer -------------------------------------------------------------

# name, with accents, listed in the supplier extractor
PROVINCES = [
    ("Ciudad Autónoma de Buenos Aires", False),
    ("Tierra del Fuego", True),
    ("Santiago del Estero", True),
    ("Buenos Aires", True),
    ("Santa Cruz", True),
    ("Santa Fe", True),
    ("Río Negro", True),
    ("Entre Ríos", True),
    ("La Pampa", True),
    ("La Rioja", True),
    ("San Juan", True),
    ("San Luis", True),
    ("Catamarca", True),
    ("Chaco", True),
    ("Chubut", True),
    ("Córdoba", True),
    ("Corrientes", True),
    ("Formosa", True),
    ("Jujuy", True),
    ("Mendoza", True),
    ("Misiones", True),
    ("Neuquén", True),
    ("Salta", True),
    ("Tucumán", True),
]

LOCALITIES = [
    "Buenos Aires", "Campo Quijano", "Catamarca", "Chaco", "Chubut", "Comodoro Rivadavia",
    "Córdoba", "General Mosconi", "Jujuy", "La Pampa", "Mendoza", "Salta", "San Juan", "Tucumán",
]

MISREADS = [
    ("Satta", "Salta"),
    ("JWUY", "Jujuy"),
    ("Campo Quljano", "Campo Quijano"),
    ("General Mosconl", "General Mosconi"),
    ("Comodoro Rivadavla", "Comodoro Rivadavia"),
]

# --- identifier and wording patterns ---------------------------------------

CUIT = EDGE_L + r"\d{2}-\d{8}-\d" + EDGE_R
DNI = EDGE_L + r"\d{7,8}" + EDGE_R
CUIL = EDGE_L + r"(?:\d{10,11}|\d{2}[- ]?\d{7,8}[- ]?\d)" + EDGE_R
CLASSIFIER_CUIL = EDGE_L + r"\d{2}[- ]?\d{7,8}[- ]?\d" + EDGE_R
WORKPLACE = (
    "(?i)" + EDGE_L
    + r"(?:CAMPAMENTO\s+MARIANA|OFICINA(?:\s*/\s*|\s+Y\s+)?PROYECTOS?|PROYECTOS?)" + EDGE_R
)
COMPANY_SUFFIX = (
    "(?i)" + EDGE_L
    + r"(?:S\.?\s*R\.?\s*L\.?|S\.?\s*A\.?|SOCIEDAD\s+ANONIMA"
    + r"|SOCIEDAD\s+DE\s+RESPONSABILIDAD\s+LIMITADA)" + EDGE_R
)
CLASSIFIER_COMPANY = (
    EDGE_L + "(?:s r l|s a|sociedad anonima|sociedad de responsabilidad limitada)" + EDGE_R
)
CONTRACT_DATE = (
    "(?i)" + EDGE_L + r"(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"
    + r"(?:\s+(?:al|a)\s+\d{1,2}[./-]\d{1,2}[./-]\d{2,4})?" + EDGE_R
)
SECTION_DATE = (
    EDGE_L + r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}" + EDGE_R + "|" + EDGE_L + r"\d{4}" + EDGE_R
)
FILE_REFERENCE = "(?i)" + EDGE_L + r"(?:resoluci[oó]n|expediente|expte\.?)\s*[:-]?\s*[^.;,\n]+"
ANNEX_ROW = (
    r"(?i)^(\d+)\s+(.+?)\s+([IVXLCDM]+)\s+(\d+)\s+"
    r"(Permanente|Única|Unica|Por evento|Anual|Bianual|Mensual|Trimestral)\s+"
    r"(Permanente|Sin plazo|Días corridos|Dias corridos|Días hábiles|Dias habiles|Calendario)?"
    r"\s*(\d+)?$"
)

ROSTER_NOISE = [
    "nomina del personal", "nombre y apellido", "cuil", "lugar de trabajo", "localidad",
    "provincia", "numero", "nro", "secretaria", "folio", "sec",
]
COMPANY_NOISE = [
    "empresa", "cuit", "nombre apellido", "nombre y apellido", "dni", "provincia", "localidad",
    "escaneado con camscanner", "camscanner",
]
IGNORED_TEXTS = [
    "Escaneado con CamScanner", "CamScanner", "https://v3.camscanner.com", "Secretaría",
    "Secretaria", "Folio", "Sello",
]

# --- markers and signals ---------------------------------------------------

ANNEX_MARKERS = [
    "n anexo", "nombre anexo", "romano", "n punto", "frecuencia", "tipo de plazo", "cant dias",
]

SECTION_MARKERS = [
    "Audiencia Pública", "Campamento", "Componentes del Proyecto", "Concesionario",
    "Consumo de Agua", "Consumo Eléctrico", "Correo", "Domicilio", "Documentos en Proceso",
    "Empresa", "Etapa del proyecto", "Inicio Actividad", "Inspecciones Realizadas", "Inversión",
    "Mineral/Sustancia", "Pozo de producción", "Producción anual", "Proyecto",
    "Representante Legal", "Resoluciones Anteriores", "Teléfono", "Zona Geográfica",
]

FILE_NAME_KEYWORDS = {
    "table": [
        "contrataciones", "lista", "listado", "nomina", "padron", "planilla", "proveedores",
        "registro", "tabla",
    ],
    "invoice": [
        "arca", "cadtv", "carga", "certificado", "comprobante", "declaracion", "dtve", "factura",
        "guia", "jurada", "movimiento", "recibo", "remito", "senasa", "ticket", "transporte",
    ],
    "report": [
        "antecedentes", "descriptivo", "expediente", "ficha", "informe", "inspecciones",
        "proyecto", "respuesta", "resoluciones", "resumen", "tecnico",
    ],
}

CLASSIFIER_SIGNALS = {
    "location": ["provincia", "localidad", "salta", "jujuy", "catamarca", "mendoza", "chicoana"],
    "roster": [
        "nomina del personal", "nombre y apellido", "cuil", "lugar de trabajo", "localidad",
        "provincia",
    ],
    "movement": [
        "fechasalida", "cantidadcamion", "proveedor", "producto", "origen", "destino",
        "fechaarribo",
    ],
    "operating": ["dtv", "dtve", "senasa", "arca", "cuve", "cadtv", "patente", "transportista"],
    "commercial": [
        "factura", "ticket", "recibo", "comprobante", "remito", "importe", "total",
        "forma de pago",
    ],
    "technical": [
        "informe", "resumen", "expediente", "resolucion", "proyecto", "antecedentes",
        "inspeccion", "documentacion administrativa",
    ],
    "table": [
        "nro", "numero", "nombre", "fecha", "cantidad", "descripcion", "localidad", "provincia",
        "cuit", "cuil",
    ],
}
GENERIC_TABLE_WORDS = [
    "fecha", "proveedor", "producto", "origen", "destino", "cantidad", "tons", "cuit",
]

# --- profiles: id, extraction profile, extraction mode, expected columns

PROFILES = [
    ("internal-general", "general", None, []),
    ("internal-documento-tecnico-administrativo", "technical-admin", "text_chunks", []),
    ("internal-dtve-senasa-arca", "commercial-operations", None, []),
    ("internal-comprobante-generico", "commercial-operations", None, []),
    ("internal-movimiento-camiones", "vision-table", "vision_table", MOVEMENT_COLUMNS),
    ("internal-personal-empresa-localidad", "personnel-company-location", "text_chunks", COMPANY_COLUMNS),
    ("internal-nomina-personal", "personnel-roster", "text_chunks", ROSTER_COLUMNS),
    ("internal-tabla-administrativa", "table-list", "direct_file", []),
]

PROFILE_ALIASES = {
    "": "internal-general",
    "auto": "internal-general",
    "custom": "internal-general",
    "general": "internal-general",
    "internal-general": "internal-general",
    "mateo": "internal-dtve-senasa-arca",
    "movimiento": "internal-movimiento-camiones",
    "technical-admin": "internal-documento-tecnico-administrativo",
}

# --- plans: name, description, daily, monthly, PDF MB, image MB, JSON export, own profile

PLANS = [
    ("Demo", 5, 10, 20, 10, True, False),
    ("Piloto", 20, 100, 50, 20, True, True),
    ("Basico", 50, 500, 50, 20, True, True),
    ("Profesional", 150, 2000, 50, 20, True, True),
    ("Empresa", 9999, 99999, 50, 20, True, True),
]

# Words of error texts: those worth a retry, and the classes in the order in which they are tried.
RETRYABLE = [
    "high demand", "service unavailable", "temporarily unavailable", "timeout", "timed out",
    "too many requests", "quota", "resource exhausted", "network", "fetch failed", "econnreset",
    "etimedout", "enotfound",
]
ERROR_CLASSES = [
    ("profile_validation", ["profileextractionvalidationerror", "profile_extraction_validation_error",
                            "profile_rejected_generic_line_csv"]),
    ("quota", ["429", "too many requests", "quota", "resource exhausted", "high demand", "fetch failed",
               "service unavailable", "temporarily", "saturad", "network"]),
    ("html_leak", ["unexpected token '<'", "<!doctype", "<html"]),
    ("low_quality", ["aioutputqualityerror", "ai result quality was too low", "ai_output_quality_low"]),
    ("quality_gate", ["ocr_quality_gate_failed", "ocr_fallback_quality_gate_failed", "quality gate"]),
    ("timeout", ["ocr processing timed out", "procesamiento tard"]),
    ("temporary", ["googleaitemporaryerror"]),
    ("structured_output", ["structuredoutputerror"]),
    ("advanced_reader", ["google document ai", "google_document_ai", "advanced_ocr_normalization"]),
]

# Kinds of attempts in the order in which their results are preferred.
ATTEMPT_KINDS = ["primary", "fallback", "experimental", "visual", "local"]

# Notes on a recovered supplier table.
RECOVERY_WARNINGS = [
    "La revisión automática detectó dudas de alineación, pero se reconstruyó una tabla utilizable a partir de encabezados y CUIT detectados.",
    "Se recomienda revisión manual de filas con celdas partidas.",
]

# --- limits ----------------------------------------------------------------

MAX_FILE_MB = 50
MAX_PAGES = 30
CHUNK_CHARS = 12000
CHUNK_OVERLAP = 500
MAX_BALANCED_CHUNKS = 4
MIN_CONFIDENCE = 0.75
RATE_LIMIT = 5
RATE_WINDOW_SECONDS = 600
