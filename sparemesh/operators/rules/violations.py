"""What each violation code stands for (module, standard, failure it prevents)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIOLATIONS = {
    "DIMENSIONAL_ZERO_TOLERANCE": ("DIMENSIONAL_ZERO_TOLERANCE", "ASME B16.5 / B36.10M", "Physical dimensional mismatch — part cannot mate or bolt"),
    "CLASS_DOWN": ("ASME_B16_5", "ASME B16.5 Table 2", "Hydrostatic rupture under operating design pressure"),
    "BOLT_CIRCLE": ("ASME_B16_5", "ASME B16.5 Bolt Circle Invariant", "Flange mating dimension mismatch (bolt circle, OD, bolt holes differ)"),
    "PSI_DOWN": ("ASME_B16_5", "ASME B16.5 / B31.3", "Pressure containment failure and rupture risk"),
    "CRYOGENIC": ("ASTM_METALLURGY_DAG", "ASTM A350 LF2", "Cryogenic brittle fracture at -46°C due to lack of Charpy impact testing"),
    "SENSITIZATION": ("ASTM_METALLURGY_DAG", "ASTM A182 (L-grade)", "Intergranular stress corrosion cracking from sensitization"),
    "CREEP": ("ASTM_METALLURGY_DAG", "ASME B31.3 / ASTM A335", "Creep rupture and accelerated graphitization failure in high-temperature service"),
    "METAL_DOWN": ("ASTM_METALLURGY_DAG", "ASTM Metallurgy DAG", "Corrosion, creep, or mechanical failure from metallurgy downgrade"),
    "SLIP_ON": ("ASME_B31_3_CYCLIC", "ASME B31.3 Severe Cyclic Service", "Slip-on flange fillet weld fatigue fracture"),
    "FACING": ("ASME_B16_5_FACING", "ASME B16.5", "Joint seal failure from incompatible gasket seating face geometry"),
    "CAST_IRON": ("ASME_B31_3_CAST_IRON", "ASME B31.3 Section 312.2", "Brittle cast iron flange ear bending moment cracking"),
    "CONNECTION": ("FACING_AND_CONNECTION_MISMATCH", "ASME B16.5 / B16.25", "Joint seal and connection mismatch preventing assembly"),
    "SCHEDULE_DOWN": ("ASME_B36_10M_SCHEDULE", "ASME B36.10M", "Thin-wall pipe burst under hoop stress"),
    "COATING_THIN": ("COATING_THICKNESS", "ISO 21809 / NACE SP0188", "Premature external corrosion and pinhole leakage from under-gauge coating"),
    "SOUR": ("NACE_MR0175_SOUR", "NACE MR0175 / ISO 15156", "Catastrophic sulfide stress cracking (SSC) and hydrogen-induced cracking (HIC)"),
    "SOUR_HARDNESS": ("NACE_MR0175_HARDNESS", "NACE MR0175 clause A.2.1.2", "Sulfide stress cracking in high hardness carbon steel"),
    "LIQUID_METAL": ("ASTM_A193_LME", "ASTM A193 / LME Invariant", "Liquid metal embrittlement cracking from molten zinc/cadmium"),
    "FASTENER_STRENGTH": ("FASTENER_STRENGTH", "ASTM A193 / ASTM A320", "Bolt yield elongation and joint flange blowout under operating load"),
    "COLD_BOLT": ("ASTM_A320_CRYOGENIC", "ASTM A320 Gr. L7", "Low-temperature brittle fracture of bolt under cryogenic thermal shock"),
    "NUT": ("ASTM_A194_NUT", "ASTM A194 Gr. 2H", "Commercial nut thread stripping under high bolt preload"),
    "GASKET_TEMPERATURE": ("ASME_B16_21_TEMPERATURE", "ASME B16.21", "Elastomer or gasket degradation and blowout under high temperature"),
    "GASKET_FILLER": ("ASME_B16_20_FILLER", "ASME B16.20", "PTFE filler thermal degradation, creep relaxation and blowout"),
    "INNER_RING": ("ASME_B16_20_INNER_RING", "ASME B16.20 Table 4", "Radial inward winding buckling into pipe bore under high bolt load"),
    "RING_JOINT": ("ASME_B16_20_RTJ", "ASME B16.20 / API 6A", "BX gasket dimensional incompatibility in ASME B16.5 R grooves"),
    "GASKET_HARDNESS": ("ASME_B16_20_HARDNESS", "ASME B16.20 Section 3.2", "RTJ flange groove indentation, galling, and plastic deformation"),
    "TRIM": ("API_600_TRIM", "API 600 Table 3", "Rapid seat washout and wire-drawing erosion in erosive fluid"),
    "BORE": ("API_6D_BORE", "API 6D Section 5.1", "Pipeline scraper (PIG) tool trapped in restricted valve bore"),
    "FIRE_SAFE": ("API_607_FIRE_SAFE", "API 607 / API 6FA", "Polymer seat melting and fueling refinery hydrocarbon fire"),
    "BUTTERFLY": ("API_609_CATEGORY", "API 609", "Resilient rubber liner blowout in refinery process service"),
    "SOFT_SEAT": ("API_608_SOFT_SEAT", "API 608 / ASME B16.34", "Polymer seat liquefaction and catastrophic loss of shutoff at elevated temperature"),
    "RETAINER": ("API_594_RETAINERLESS", "API 594 clause 4.2", "Fugitive pin leak of toxic media through valve body penetrations"),
    "OPERATION": ("VALVE_OPERATION", "API 600 / ISO 5211", "Actuator / automation operation mismatch"),
    "END_CONNECTION": ("VALVE_END_CONNECTION", "ASME B16.5 / B16.25", "End connection geometric incompatibility"),
    "ORIFICE": ("API_526_ORIFICE", "API 526 Section 2", "Vessel overpressure detonation from undersized relief orifice"),
    "SET_PRESSURE": ("API_520_CDTP", "API 520 Part I", "PSV set pressure mismatch"),
    "FRAGMENTING": ("ASME_UG127_RUPTURE_DISK", "ASME Section VIII Div 1 UG-127 / API 520", "Metal petals shearing off and clogging downstream PSV nozzle"),
    "DISK_FATIGUE": ("ISO_4126_2_FATIGUE", "ISO 4126-2", "Premature cyclic fatigue rupture of tension-loaded disk"),
    "SERIES": ("ASME_B16_47_SERIES", "ASME B16.47 / MSS SP-44 / API 605", "Bolt circle & hole pattern mismatch causing joint failure"),
    "FITTING_DOWN": ("ASME_B16_11", "ASME B16.11", "Socket-weld or threaded fitting rupture under pressure"),
    "FITTING_LADDER": ("ASME_B16_11", "ASME B16.11", "Fitting joint pressure containment failure"),
    "ELBOW": ("ASME_B16_9_ELBOW", "ASME B16.9", "Pipeline scraper (PIG) stuck in short radius elbow"),
    "SMYS": ("MSS_SP_75_SMYS", "MSS SP-75 / API 5L", "Fitting yield deformation and burst under transmission gas pressure"),
    "MOTOR_EX": ("IEC_60079_MOTOR_EX", "IS/IEC 60079-1", "Electric spark igniting explosive vapor atmosphere in refinery unit"),
    "MOTOR_SPEED": ("MOTOR_POLE_MISMATCH", "IS 325 / IEC 60034", "Hydraulic head surge and pump casing overpressure blowout"),
    "MOTOR_POWER": ("MOTOR_POWER_UNDER_RATING", "IEC 60034-1", "Motor thermal winding burnout and frequent trip under full pump load"),
    "MOTOR_VOLTAGE": ("MOTOR_VOLTAGE", "IEC 60038", "Motor winding insulation breakdown or phase under-voltage tripping"),
    "MOTOR_FREQUENCY": ("MOTOR_FREQUENCY", "IEC 60034", "Motor magnetic core saturation and excessive slip heating"),
    "MOTOR_IP": ("MOTOR_IP_RATING", "IEC 60529", "Water ingress and dust penetration into electrical windings"),
    "SEAL_PLAN": ("API_PLAN_DOWNGRADE", "API 682 4th Edition", "Toxic or carcinogenic volatile hydrocarbon atmospheric seal blowout due to API plan downgrade"),
    "COMPRESSOR_PLAN": ("API_682_COMPRESSOR_PLAN", "API 682 / API 692", "Compressor barrier fluid pressure loss and gas escape"),
    "ELASTOMER": ("SEAL_MATERIAL_DOWNGRADE", "API 682 Annex B", "Elastomer thermal degradation, chemical swelling, and seal extrusion"),
    "BEARING_TYPE": ("ISO_15_BEARING_TYPE", "ISO 15 / ABMA Standard 20", "Bearing fatigue spalling and dynamic load mismatch"),
    "BEARING_CLEARANCE": ("ISO_15_CLEARANCE", "ISO 5753-1 / ISO 15", "Shaft thermal expansion bearing seizure and catastrophic shaft snap"),
    "PUMP_FLOW": ("PUMP_FLOW_RATE", "API 610 Section 6", "Process starvation and pump cavitation under undersized delivery rate"),
    "PUMP_COUPLING": ("PUMP_COUPLING", "API 671 / API 610", "Shaft misalignment vibration and bearing failure"),
    "PUMP_MOUNTING": ("API_610_MOUNTING", "API 610 Clause 6.3.3", "Thermal shaft misalignment and mechanical seal destruction"),
    "PUMP_CLASS": ("API_610_MATERIAL_CLASS", "API 610 Annex H", "Pump casing erosion and toxic fluid release"),
    "WEAR_RING": ("API_610_WEAR_RING", "API 610 Clause 6.7.2", "Rotating/stationary wear ring galling seizure and rotor lockup"),
    "CYLINDER_VALVE": ("API_618_CYLINDER_VALVE", "API 618 5th Edition", "Inverted valve cylinder re-compression heating and cylinder head detonation"),
    "DRY_GAS_SEAL": ("API_692_DGS", "API 692", "Explosive gas escape and compressor bay fire blowout"),
    "IMPELLER": ("API_617_IMPELLER_METALLURGY", "API 617 / NACE MR0175", "High-speed impeller burst from sulfide stress cracking in sour gas"),
    "PSL": ("API_5L_PSL", "API 5L / ASME B31.8", "Brittle pipeline fracture in high-pressure gas grid"),
    "CATEGORY_M_JOINT": ("ASME_B31_3_CAT_M", "ASME B31.3 Chapter VIII M300", "Lethal toxic atmospheric gas escape via threaded joint"),
    "CATEGORY_M": ("ASME_B31_3_CAT_M", "ASME B31.3 Chapter VIII", "Lethal toxic atmospheric gas escape"),
    "WELDED_PIPE": ("PIPE_MFG_METHOD", "ASME B31.3 Section 300", "Longitudinal weld seam rupture in lethal/hydrogen service"),
    "TUBING_OD": ("ASTM_A269_TUBING_OD", "ASTM A269", "Tubing compression ferrule blowout under impulse pressure"),
    "TUBING_HARDNESS": ("ASTM_A269_HARDNESS", "ASTM A269 / Swagelok Standards", "Ferrule slippage and joint vibration separation due to excessive tube hardness"),
    "RESTRAINT": ("EJMA_RESTRAINT", "EJMA Standards Section C", "Hydrostatic pressure thrust anchor shearing and bellows tensile rupture"),
    "HOSE_BRAID": ("ISO_10380_HOSE_BRAID", "ISO 10380", "Hose braid tensile fatigue rupture and fluid jetting"),
    "TANK_VENT": ("API_2000_PVRV", "API 2000 7th Edition", "Atmospheric storage tank shell vacuum implosion collapse"),
    "ARRESTOR": ("ISO_16852_ARRESTOR", "ISO 16852 / EN 12874", "Supersonic detonation shock wave propagating into storage tank vapor space"),
    "TANK_PAINT": ("TANK_PAINT_SYSTEM", "ISO 12944 / NACE SP0108", "Atmospheric corrosion and internal tank lining chemical attack"),
    "MICRON": ("FILTER_MICRON_RATING", "ISO 16889 / ISO 2942", "Debris passage and mechanical seal scoring / hydraulic erosion"),
    "THREAD": ("THREAD_TYPE_MISMATCH", "ASME B1.20.1 / ISO 7-1", "Thread galling and high-pressure fluid jetting leakage"),
    "STEAM_TRAP": ("STEAM_TRAP_MECHANISM", "ISO 6552 / ASME PTC 39", "Steam line condensate backup and catastrophic water hammer slug rupture"),
    "CUI": ("ASTM_C795_CUI", "ASTM C795 / NACE SP0198", "Corrosion Under Insulation (CUI) and chloride stress cracking of stainless steel"),
    "CRYO_INSULATION": ("ASTM_C552_CRYOGENIC", "ASTM C552", "Atmospheric vapor condensation ice-jacking and thermal boil-off runaway"),
    "TEMA": ("TEMA_CLASS_DOWNGRADE", "TEMA Standards 10th Edition", "Heat exchanger bundle erosion, baffle clearance bypass and premature failure"),
    "EXCHANGER_TUBE": ("HE_SEAMLESS_TUBE", "ASME Section VIII Div 1 / TEMA", "Longitudinal weld seam stress corrosion cracking and shell-side blowout"),
    "TUBE_WALL": ("TUBE_BWG_MIN_WALL", "TEMA Standards RCB-2.21", "External tube buckling collapse from under-gauge wall thickness"),
    "U_BEND": ("TEMA_U_BEND_ANNEALING", "TEMA R RCB-2.31 / ASTM A688", "Chloride stress corrosion cracking in residual stress U-bend zone"),
    "LINE_BLIND": ("ASME_B16_48_BLIND", "ASME B16.48", "Unreinforced flat plate plastic yield blowout under pressure"),
    "INSULATION_KIT": ("NACE_SP0286_FIK", "NACE SP0286", "Conductive debris bridging flange gap causing galvanic perforation"),
    "KIT_RETAINER": ("NACE_SP0286_RETAINER", "NACE SP0286", "Dielectric retainer thermal breakdown and isolation failure"),
}


def violation(outcome: Column) -> Column:
    """Outcome with a code to struct(module_name, standard_code, failure_mode_prevented, explanation)."""
    table = F.create_map(
        *[
            x
            for code, (module, standard, failure) in VIOLATIONS.items()
            for x in (
                F.lit(code),
                F.struct(F.lit(module).alias("m"), F.lit(standard).alias("s"), F.lit(failure).alias("f")),
            )
        ]
    )
    row = F.try_element_at(table, outcome["code"])
    return F.struct(
        row["m"].alias("module_name"),
        row["s"].alias("standard_code"),
        row["f"].alias("failure_mode_prevented"),
        outcome["note"].alias("explanation"),
    )
