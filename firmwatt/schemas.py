"""One explicit schema per input, as DDL text; nothing is inferred."""


# Hourly series as delivered: calendar parts and decimal-comma text.
RAW_WIND = (
    "Ano string, Mes string, Dia string, Hora string, DireccionViento string, "
    "PresionAtmosferica string, Ta string, VelocidadViento string"
)
RAW_SOLAR = ("Ano string, Mes string, Dia string, Hora string, Ghi string, Ta string")

_COMMON = (
    "NombrePlanta: string, Cen: double, Ihf: double, Ppi: double, Kpc: double, Kt: double, "
    "Kin: double, Latitud: double, Longitud: double, InformacionMedida: boolean"
)

WIND_BODY = (
    f"ParametrosTransversales struct<{_COMMON}, Offshore: boolean, Elevacion: double, "
    "Voltaje: double>, "
    "ParametrosConfiguracion struct<"
    "SistemasDeMedicion: array<struct<IdentificadorTorre: string, Latitud: double, "
    "Longitud: double, Elevacion: double, RadioRepresentatividad: double, "
    "CantidadAnemometro: int, ConfiguracionAnemometro: array<struct<Anemometro: int, "
    "AlturaAnemometro: double>>, ArchivoSeriesRelacionado: string>>, "
    "Aerogeneradores: array<struct<ModeloAerogenerador: string, AlturaBuje: double, "
    "DiametroRotor: double, PotenciaNominal: double, VelocidadNominal: double, "
    "DensidadNominal: double, VelocidadCorteInferior: double, "
    "VelocidadCorteSuperior: double, TemperaturaAmbienteMinima: double, "
    "TemperaturaAmbienteMaxima: double, CurvasDelFabricante: array<struct<"
    "SerieVelocidad: double, SeriePotencia: double, SerieCoeficiente: double>>, "
    "CantidadAerogeneradores: int, EspecificacionesEspacialesAerogeneradores: array<struct<"
    "Aerogenerador: bigint, Latitud: double, Longitud: double, Elevacion: double, "
    "MedicionAsociada: struct<Value: string>>>>>, "
    "ParametroConexion: array<struct<Conexion: int, CantidadAerogeneradoresConexion: int, "
    "Resistencia: double, ConexionAerogenerador: array<struct<OrdenConexion: int, "
    "IdentificadorAerogenerador: bigint>>>>>, "
    "ArchivoSeries struct<Nombre: string>"
)

SOLAR_BODY = (
    f"ParametrosTransversales struct<ZonaHoraria: string, Altitud: double, Albedo: double, "
    f"L: double, {_COMMON}>, "
    "ParametrosConfiguracion struct<GrupoInversores: array<struct<"
    "ParametrosInversor: struct<ReferenciaInversor: string, NInv: int, PACnominal: double, "
    "PDCnominal: double, VDCnominal: double, PDCarranque: double, PACnocturnoW: double, "
    "PowerAc: array<double>, PowerDc: array<double>>, "
    "ParametrosModulo: struct<ReferenciaModulo: string, Tnoct: double, "
    "Tecnologia: struct<Value: string>, Ns: double, Iscstc: double, Vocstc: double, "
    "Impstc: double, Vmpstc: double, AlphaSc: double, BetaOc: double, GammaPmp: double, "
    "Pnominalstc: double, Psi: double, Bifacial: boolean, Bifacialidad: double, "
    "AltoFilaPaneles: double, AnchoFilaPaneles: double>, "
    "EstructuraYConfiguracion: struct<NSubarrays: int, "
    "EstructuraPlantaConSeguidores: boolean, CantidadPanelConectados: array<struct<"
    "Id: int, CantidadSerie: int, CantidadParalero: int, OAzimutal: double, "
    "OElevacion: double, Racking: struct<Value: string>, OMax: double>>>>>>, "
    "ArchivoSeries struct<Nombre: string>"
)

# A request message: the plant kind (0 solar, 1 wind) and the body as text.
REQUEST = ("plant_id bigint, TipoMensaje int, CuerpoMensaje string")
