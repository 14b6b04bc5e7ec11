"""Names by which the analytics find their signals in the metadata."""

# Parameter, subsystem, component and label names as the instruments export them.
EPU_SESSION = {"param_name": "EpuSessionID", "subsystem": "EPU"}
EPU_STATE = {"param_name": "AutomatedAcquisitionState", "subsystem": "EPU"}
EPU_IMAGES = {"param_name": "CompletedExposuresCount", "subsystem": "EPU"}
EPU_SKIPPED = {"param_name": "SkippedExposuresCount", "subsystem": "EPU"}
TOMO_SESSION = {"param_name": "SessionId", "subsystem": "Tomography"}
TOMO_STATE = {"param_name": ["Tomo5TiltSeriesState", "TiltSeries"], "subsystem": "Tomography"}
TOMO_IMAGES = {"param_name": "TemImageCount", "subsystem": "Tomography"}
TOMO_POSITIONS = {"param_name": "TiltSeriesNumberOfPositions", "subsystem": "Tomography"}
TOMO_MAPS = {"param_name": "SearchMapsPerJob", "subsystem": "Tomography"}
SERVER = {"param_name": "Value", "component": "Server"}
SERVER_SOFTWARE = {"param_name": "Value", "component": "Server", "subsystem": "Software"}
VACUUM = {"param_name": "VacuumState"}
IMAGE_COUNTERS = {"param_name": ["AcquisitionJobs", "BM-Falcon-NumberOfAcquisitionJobs", "AcquisitionNumber"]}
DATA_COUNTERS = {"param_name": ["NumberOffloadedTerabytes", "BM-Falcon-NumberOffloadedTB"]}
LOAD_COUNTERS = {
    "daily_cartridge_count": "LoadCartridgeCounter",
    "daily_cassette_count": "LoadCassetteCounter",
}
CRYO_CYCLES = {"param_name": ["AutoloaderCryoCycleDuration", "ColumnCryoCycleDuration"]}
FAMILY = {"param_name": "ProductFamily"}
SERIAL = {"param_name": "SerialNumber"}
AVAILABILITY = {"param_name": "Availability", "display_name": ["Camera availability", "Availability"]}
FILTER_STATUS = {
    "subsystem": "EnergyFilterBrick",
    "param_name": ["EnergyFilterSlitAvailable", "EnergyFilterIsAvailable"],
}
DISCONNECTIONS = {"param_name": "NrDisconnectionsFromCSU"}
CAMERA_ERRORS = {"param_name": "AvailabilityReason", "component": "EF-CCD"}
CAMERA_GOOD = ["CameraAvailable", "RPCConnectionEstablished"]
SENSOR_TEMPERATURE = {"param_name": "SensorTemperature", "display_name": "Sensor temperature"}
SCREEN_CURRENT = {"subsystem": "MdlFluScreenBrick", "param_name": "ScreenCurrent"}
PRESSURE_BY_FAMILY = {"Talos": "PPmPressure"}
PRESSURE_OTHERWISE = "CCGpPressure"

RUNNING = ["Running"]
TOMO_RUNNING = ["Running", "Acquiring"]
TERMINATED = ["Terminated"]

VACUUM_CLASSES = {
    "cryocycle": [
        "ColumnConditioning", "Column Conditioning", "TMPmOnColumn", "CryoCycle", "Cryo Cycle",
        "CryoCycle_Time", "CryoCycle_Delay",
    ],
    "closed": ["All Vacuum [Closed]", "AllVacuumColumnValvesClosed", "AllVacuum_LinersClosed"],
    "open": ["All Vacuum [Opened]", "AllVacuumColumnValvesOpened", "AllVacuum_LinersOpened"],
}

# status tables: alternatives per module
MODULES = {
    "FEG": [{"param_name": "FegState", "display_name": "Feg State", "subsystem": ["MdlGunBrick", "MdlTemFegBrick"]}],
    "HT": [
        {"param_name": "HTTankState", "component": "HTTank", "subsystem": "MdlGunBrick"},
        {"param_name": "HTTankAvailable", "component": "HTTank", "subsystem": "MdlHighTensionBrick"},
    ],
    "Stage": [{"param_name": ["Status", "CompuStageStatus"], "subsystem": ["Compustage", "MdlSmc"]}],
    "Optics": [{"param_name": ["OpticsOperationalState", "Optics_OperationalState"]}],
    "Autoloader": [{"param_name": "AutoloaderUpStatus"}],
    "Temperature": [{"param_name": "TemperatureControlUpStatus"}],
    "Energy filter": [{"subsystem": "EnergyFilterBrick", "param_name": "EnergyFilterIsAvailable"}],
}

PC_HEALTH = {
    "CPU load avg": {"param_name": "CPULoadAvg", "subsystem": "SystemMonitoring", "component": "Windows"},
    "Free space": {"param_name": "FreeHDDSpace_C", "subsystem": "SystemMonitoring", "component": "Windows"},
    "Memory load avg": {"param_name": "MemoryLoad", "subsystem": "SystemMonitoring", "component": "Windows"},
    "Disk C: temperature": {
        "param_name": "SMART_SystemDisk_194", "subsystem": "SystemMonitoring", "component": "SMART_SystemDisk"},
    "GPU temperature": {"param_name": "ADLTemperature", "subsystem": "SystemMonitoring", "component": "GPU"},
    "Uncorrectable Sector Count": {
        "param_name": "SMART_SystemDisk_198", "subsystem": "SystemMonitoring", "component": "SMART_SystemDisk"},
    "MB temperature": {
        "param_name": "AaeonTemperatureMotherboard", "subsystem": "SystemMonitoring", "component": "Motherboard"},
}

UP_VALUES = "(?i)^(Up|Operate|On|Enabled|Available)$"
