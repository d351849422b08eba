"""Sheet layouts of the supported workbooks.

Fixed values: sheet names, ranges, first rows, dropped positions and column names below
are given by the published workbooks and by the tables users query, so they are stated
as they are.
"""

from __future__ import annotations

from serieslake.sources.sheets import SheetRange

BASE_MONEY = """
    date vdFeTotal vdFeComSP vdFeComTN vdFeOtrasOpTNAT vdFeOtrasOpTNTU vdFeOtrasOpTNResto
    vdFePasesLeliqPases vdFePasesLeliqLeliqNotaliq vdFePasesLeliqRedescuentos
    vdFePasesLeliqIntereses vdFeLebacNobac vdFeRescateCuasi vdFeOperacionesLEFI vdFeOtros
    vdBMCMBilletesPublico vdBMCMBilletesEntidades vdBMCMBilletesChequesCan vdBMCtaCteEnBCRA
    vdBMTotalsinCuasi vdBMMasCuasiCuasimonedas vdVBMTotal sdBMCMBilletesPublico
    sdBMCMBilletesEntidades sdBMCMBilletesChequesCan sdBMCtaCteEnBCRA sdBMTotalsinCuasi
    sdBMMasCuasiCuasimonedas sdVBMTotal tipoSerie
"""

RESERVES = """
    date stockTotal stockOroColPlazoOtros stockDivisasPasePasivoUSDExterior vdReservasIntl
    vdFeCompraDivisas vdFeOrgIntl vdFeOtrasOpSP vdFeEfecMinimo vdFeOtros AsigDEGs TC
    tipoSerie
"""

DEPOSITS = """
    date ptCtaCte ptCA ptPFNoAjust ptPFAjustCERUVA ptOtros ptCedrosCER ptTotalDepositos
    ptBodenContabilizado ptTotal pSPPesosCtaCte pSPPesosCA pSPPesosPFNoAjust
    pSPPesosPFAjustCERUVA pSPPesosOtros pSPPesosCedrosCER pSPPesosTotalDepositos
    pSPPesosBodenContabilizado pSPPesosTotal depositosDolaresExprPesosTotal
    depositosDolaresExprPesosSPrivado depositosTotales depositosTotalesSectorPrivado
    depositosDolaresExprDolaresTotal depositosDolaresExprDolaresSPrivado M2
    M2_transac_privado tipoSerie
"""

LOANS = """
    date prestamosSPPesosAdelantos prestamosSPPesosDocumentos prestamosSPPesosHipotecarios
    prestamosSPPesosPrendarios prestamosSPPesosPersonales prestamosSPPesosTarjetas
    prestamosSPPesosOtros prestamosSPPesosTotal prestamosSPDolaresAdelantos
    prestamosSPDolaresDocumentos prestamosSPDolaresHipotecarios
    prestamosSPDolaresPrendarios prestamosSPDolaresPersonales prestamosSPDolaresTarjetas
    prestamosSPDolaresOtros prestamosSPDolaresTotal prestamosSPMillonesPesosDolares
    prestamosSPPesosMasDolares tipoSerie
"""

RATES = """
    date PF3044DiasPesosTotalGeneralTNA PF3044DiasPesosHastaCienmilTNA
    PF3044DiasPesosHastaCienmilTEA PF3044DiasPesosMasUnmillonTNA
    PF3044DiasDolaresTotalGeneralTNA PF3044DiasDolaresHastaCienmilTNA
    PF3044DiasDolaresMasUnmillonTNA badlarPesosTotalTNA badlarPesosTotalBancosPrivadosTNA
    badlarPesosTotalBancosPrivadosTEA TM20PesosTotalTNA TM20PesosBancoprivadosTNA
    TM20PesosBancoprivadosTEA prestamosPersonalesPesosTotalTNA adelantosPesosTotalTNA
    callPesosEntreprivadosTasaTNA callPesosEntreprivadosMontoMillones callPesosTotalTasaTNA
    callPesosTotalMontoMillones pasesEntreTerceros1DiaTNA pasesEntreTercerosMontoMillones
"""

INSTRUMENTS = """
    date saldosPasesPasivosPesosTotal saldosPasesPasivosPesosFCI saldosPasesActivosPesos
    saldosLeliqNotaliq saldosLebacNobacPesosLegarLeminTotal
    saldosLebacNobacPesosLegarLeminEntFinancieras saldosLebacDolaresLediv saldosNocom
    tasaPolMonTNA tasaPolMonTEA tasaPasePesosPasivo1Dia tasaPasePesosPasivo7Dias
    tasaPasePesosActivo1Dia tasaPasePesosActivo7Dia tasaLebacPesosLeliq1M
    tasaLebacPesosLeliq2M tasaLebacPesosLeliq3M tasaLebacPesosLeliq4M tasaLebacPesosLeliq5M
    tasaLebacPesosLeliq6M tasaLebacPesosLeliq7M tasaLebacPesosLeliq8M tasaLebacPesosLeliq9M
    tasaLebacPesosLeliq10M tasaLebacPesosLeliq11M tasaLebacPesosLeliq12M
    tasaLebacPesosLeliq18M tasaLebacPesosLeliq24M tasaPesosCER6M tasaPesosCER12M
    tasaPesosCER18M tasaPesosCER24M tasaLebacDolar1MLiquidablePesos
    tasaLebacDolar6MLiquidablePesos tasaLebacDolar12MLiquidablePesos
    tasaLebacDolar1MLiquidableDolar tasaLebacDolar3MLiquidableDolar
    tasaLebacDolar6MLiquidableDolar tasaLebacDolar12MLiquidableDolar
    tasaNobacPesosVariableBadlarBcoPriv9M tasaNobacPesosVariableBadlarBcoPriv1A
    tasaNobacPesosVariableBadlarTotal2A tasaNobacPesosVariableBadlarBcoPriv2A
    tasaNotaliqPesosVariableTasaPolMon190d vacio saldolefi
"""

DAILY_BALANCE = """
    date reservasIntSaldosUSDTotal reservasIntSaldosUSDOroDivColocOtros
    reservasIntSaldosUSDDividsasPasePasivoUSDExterior princPasSaldosPESOSPasMonetariosTotal
    princPasSaldosPESOSPasMonetariosBMTotal princPasSaldosPESOSPasMonetariosBMCMTotal
    princPasSaldosPESOSPasMonetariosBMCMChequesCancel
    princPasSaldosPESOSPasMonetariosBMCtaCteTotal
    princPasSaldosPESOSPasMonetariosBMCtaCteFondosPagoOPP
    princPasSaldosPESOSPasMonetariosBMCtaCteResto
    princPasSaldosPESOSPasMonetariosDepositosMonExtTotal
    princPasSaldosPESOSPasMonetariosDepositosMonExtDepCtaCte
    princPasSaldosPESOSPasMonetariosDepositosMonExtCEDINCheqCanc
    princPasSaldosPESOSLebacNobacMonedaNacionalSaldo
    princPasSaldosPESOSLebacNobacMonedaNacionalMontoEfectivoColocado
    princPasSaldosPESOSLebacNobacMonedaNacionalMontoVto
    princPasSaldosPESOSLebacNobacUSDSaldo
    princPasSaldosPESOSLebacNobacUSDMontoEfectivoColocado
    princPasSaldosPESOSLebacNobacUSDMontoVto
    princPasSaldosPESOSLeliqNotaliqMonedaNacionalSaldo
    princPasSaldosPESOSLeliqNotaliqMonedaNacionalMontoEfectivoColocado
    princPasSaldosPESOSLeliqNotaliqMonedaNacionalMontoVto princPasSaldosPESOSNOCOM
    princPasSaldosPESOSPosNetaPasesTotal princPasSaldosPESOSPosNetaPasesPasesPasivos
    princPasSaldosPESOSPosNetaPasesPasesActivos princPasSaldosTOTALDepGobierno
    princPasSaldosPESOSDepGobierno princPasSaldosMEDepGobierno redescuentosAdelantos
    tipoCambio
"""

REPO = """
    date ppRueda ppPlazo pptasa ppConcertacionesPublico ppConcertacionesPrivado
    ppConcertacionesOperadoBCRA ppStockPublico ppStockPrivado ppStockTotal paRueda paPlazo
    paptasa paConcertacionesPublico paConcertacionesPrivado paConcertacionesOperadoBCRA
    paStockPublico paStockPrivado paStockTotal tasaRefRIX montoOperado TPM
"""

ACTIVITY = """
    EMAE EMAEVarAnual EMAEDesest EMAEDesestVarMensual EMAETendenciaCiclo
    EMAETendenciaCiclo_var_mensual
"""

REAL_EXCHANGE = """
    date ITCRM ITCRBBrasil ITCRBCanada ITCRBChile ITCRBEEUU ITCRBMexico ITCRMUruguay
    ITCRMChina ITCRMIndia ITCRMJapon ITCRMUK ITCRMSuiza ITCRMZonaEuro ITCRMVietname
    ITCRMSudamerica
"""

PRICE_REGIONS = "nacional gba pampeana noa nea cuyo patagonia"
PRICE_ITEMS = """
    NivelGeneral AlimBebidasNoAlcohol BebidasAlcoholTabaco PrendasVestirCalzado
    ViviendaAgua Equipamiento Salud Transporte Comunicacion Recreacion Educacion
    Restaurant BsSvsVarios Estacional Nucleo Regulados Bienes Servicios
"""

LEDGER = """
    anexo mes sector concepto_especifico monto_usd cuenta categoria subcategoria
    descripcion_detallada
"""

# table: range of the sheet "DATOS | DATA", columns
DASHBOARD = {
    "infomond_base_monetaria": ("D:G", "date cta_cte circulacion_monetaria base_monetaria_total"),
    "infomond_tasa_interes": ("I:L", "date pase_pasivo pase_activo tasa"),
    "infomond_tipo_cambio": ("N:P", "date saldo_reserva_dolar tipo_cambio"),
    "infomond_agreg_monetarios": ("R:T", "date base_monetaria m2_privado"),
    "infomond_liquidez_entidades": ("V:W", "date liquidez"),
    "infomond_tasa_interes_depositos": ("Y:AB", "date badlar hasta_100mil tm20"),
    "infomond_tasa_interes_prestamos": ("AD:AF", "date adelanto_empresas personales"),
    "infomond_depositos_privados": ("AH:AK", "date plazo_fijo total vista"),
    "infomond_prestamos_privados": (
        "AM:AP",
        "date total personales_y_tarjetas adelantos_y_documentos",
    ),
    "infomond_prest_dep_otras_monedas_privados": ("AR:AT", "date prestamos depositos"),
    "infomond_pasivos_pesos_bcra": ("AV:AW", "date pasivo"),
    "infomond_factores_variacion": (
        "AY:BE",
        "date compra_divisas tesoro_nacional pases operaciones_lefi otros base_monetaria",
    ),
}

# table: sheet, range, dropped positions; names come from the header row
DEPOSIT_SHEETS = {
    "depTotalSectores": ("Total_sectores", "A:EN", (1, 2, 142)),
    "depTotalSectoresEntidadesNoInformantes": ("Total_sectores", "EP:EV", ()),
    "depSecPublico": ("Sector_público", "A:EN", (1, 2, 142)),
    "depSecPrivado": ("Sector_privado", "A:EN", (1, 2, 142)),
    "depUVA": ("UVAs", "A:L", (1, 2)),
    "depDM20TotalSectores": ("DM20_total_sectores", "A:AI", (1, 2, 33)),
    "depDM20SectorPublico": ("DM20_sector_publico", "A:AI", (1, 2, 33)),
    "depDM20SectorPrivado": ("DM20_sector_privado", "A:AI", (1, 2, 33)),
}

# End of the fixed values.


def _layout(table: str, sheet: str, span: str, first: int, names: str, **more) -> SheetRange:
    left, right = span.split(":")
    return SheetRange(table, sheet, left, right, first, tuple(names.split()), **more)


A3500 = _layout("A3500", "0", "C:D", 5, "date A3500", date_reader="dd/MM/yyyy")
CER = _layout("CER", "0", "A:B", 28, "date CER", date_reader="dd/MM/yyyy")
UVA = _layout("UVA", "0", "A:B", 28, "date UVA", date_reader="dd/MM/yyyy")
NARROW = (A3500, CER, UVA)

EMAE = _layout("EMAE", "0", "C:H", 5, ACTIVITY, date_column=None)
EMAE_FIRST_MONTH = "2004-01-01"

ITCRM = _layout("ITCRM", "0", "A:P", 3, REAL_EXCHANGE, required=("date",))

MONETARY = (
    _layout(
        "bmBCRA", "BASE MONETARIA", "A:AG", 10, BASE_MONEY,
        drop=(1, 15, 23), text_columns=("tipoSerie",),
    ),
    _layout(
        "reservas", "RESERVAS", "A:Q", 10, RESERVES,
        drop=(1, 5, 12, 14), text_columns=("tipoSerie",),
    ),
    _layout(
        "depositos", "DEPOSITOS", "A:AE", 10, DEPOSITS,
        drop=(21, 24, 27), text_columns=("tipoSerie",),
    ),
    _layout(
        "prestamos", "PRESTAMOS", "A:V", 10, LOANS,
        drop=(17, 19), text_columns=("tipoSerie",),
    ),
    _layout("tasas", "TASAS DE MERCADO", "A:V", 10, RATES),
    _layout(
        "instrumentos", "INSTRUMENTOS DEL BCRA", "A:AU", 10, INSTRUMENTS,
        drop_names=("vacio",),
    ),
)

SERIE_DIARIA = _layout(
    "serieDiaria", "Serie_diaria", "A:AI", 27, DAILY_BALANCE,
    drop=(0, 1, 6), date_reader="yyyyMMdd", required=("date",),
)

PASES = _layout(
    "pases", "0", "A:V", 5, REPO, date_reader="iso",
    text_columns=("ppRueda", "paRueda"), required=("date", "ppStockTotal"),
)

BALANCE_CAMBIARIO = _layout(
    "balance_cambiario", "1", "A:I", 2, LEDGER,
    date_column="mes", date_reader="serial_or_text",
    text_columns=tuple(n for n in LEDGER.split() if n not in ("mes", "monto_usd")),
)

DASHBOARD_BLOCKS = tuple(
    _layout(
        table, "DATOS | DATA", span, 27, names, required=("date",),
        zero_markers={"pase_pasivo": "s/o"} if table == "infomond_tasa_interes" else {},
    )
    for table, (span, names) in DASHBOARD.items()
)


def deposit_layout(table: str, header: tuple[str, ...] | None = None) -> SheetRange:
    """Layout of a deposits sheet; the first header becomes ``date``.

    Rows without a value in the second column are no observations.
    """
    sheet, span, drop = DEPOSIT_SHEETS[table]
    names = ("date", *header[1:]) if header else ()
    left, right = span.split(":")
    return SheetRange(
        table, sheet, left, right, 27, names, drop=drop,
        date_reader="yyyyMMdd", required=names[1:2],
    )


def price_columns() -> list[str]:
    """The 126 level columns: every region by every item."""
    return [region + item for region in PRICE_REGIONS.split() for item in PRICE_ITEMS.split()]


def variation_name(level: str) -> str:
    return "var" + level[0].upper() + level[1:]


def _price_rows() -> list[int]:
    """Sheet rows (1-based) of the date line and of the 126 items.

    Rows are counted from the first row of the block. Each region takes 30 rows: 13
    divisions, 2 rows apart from them 3 categories, and 2 further rows on goods and services.
    """
    offsets = [*range(13), *range(15, 18), *range(20, 22)]
    return [0, *(4 + 30 * region + o for region in range(7) for o in offsets)]


PRICE_SHEET = "2"
PRICE_FIRST_ROW = 6
PRICE_ROWS = tuple(PRICE_FIRST_ROW + r for r in _price_rows())
